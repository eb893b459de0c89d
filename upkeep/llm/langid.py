"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes; one recurrent
network reads each window forwards and one backwards, and every byte position
gets label probabilities from both states.  A document's probabilities are the
mean over all positions of its whole text; the prediction is the largest.

Training is backpropagation through time in numpy on the driver, on a bounded
sample: about ``SAMPLE_WINDOWS`` windows at hashed places of documents whose
``crc32(doc_id as text) mod 5`` is not 0 and whose ``lang`` is not null, the
same number for each language as far as there are documents.  The model (a few
thousand numbers) is sent with the tasks.  ``lang``, ``source`` and ``doc_id``
are never inputs of a prediction.

For ``accepted`` the network has one label more, learned from noise that is made
of the same sample: its windows with their characters shuffled, random codes
and key mash, digits and signs, and random letters of scripts that the sample
does not use.  A text that is noise for the most part is rejected.

Defined cases: a null text or one without a letter is ``und`` with score 1.0; so is
every text, with score 0.0, when nothing could be learned; a null doc_id is
kept, is not held out and is not learned from; repeated rows are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import map_arrow, slices

UND = "und"
REJECT = "\0noise"
MOST_NOISE = 0.5
WINDOW = 96
HIDDEN = 12
SAMPLE_WINDOWS = 12_000
MOST_WINDOWS = 16   # of one document, in small tables
EPOCHS = 6
BATCH = 200
LEAST_STEPS = 200   # small samples get more epochs
RATE = 0.02
SEED = 3
OVER_CHANCE = 1.05
WIDE = 2048         # windows of one inference step


def remainder(doc_id: Column | str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(5))


@dataclass
class Model:
    """Per direction: input table (256 x 3H, with the bias), state weights
    (H x 3H); output weights (2H x C) and bias; the languages."""
    table: list[np.ndarray]
    state: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    langs: list[str]

    def arrays(self) -> list[np.ndarray]:
        return [*self.table, *self.state, self.out, self.bias]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows (rows, padded with spaces) and how many each text has."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.full(int(counts.sum()) * WINDOW, 32, np.uint8)
    at = 0
    for t, n in zip(texts, counts):
        flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * WINDOW
    return flat.reshape(-1, WINDOW), counts


def _squash(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Softsign, x / (1 + |x|): the activation of all gates (a fraction of the
    cost of tanh); its slope is (1 - |y|)^2 at the value y."""
    scale = np.abs(x)
    scale += 1
    return np.divide(x, scale, out=out)


def _run(cols: np.ndarray, table: np.ndarray, state: np.ndarray, back: bool) -> np.ndarray:
    """Hidden states, time x H x windows, of bytes given as time x windows.

    With gates z and r = (1 + softsign) / 2 and candidate n, the next state is
    n + z (h - n); ``state`` has the candidate's part after r."""
    hid = state.shape[0]
    table, state = np.ascontiguousarray(table.T), np.ascontiguousarray(state.T)
    out = np.empty((cols.shape[0], hid, cols.shape[1]), np.float32)
    h = np.zeros((hid, cols.shape[1]), np.float32)
    pre, rec = np.empty((3 * hid, cols.shape[1]), np.float32), np.empty((3 * hid, cols.shape[1]), np.float32)
    gate, n, part = pre[:2 * hid], pre[2 * hid:], rec[2 * hid:]
    z, r = gate[:hid], gate[hid:]
    for t in range(len(cols) - 1, -1, -1) if back else range(len(cols)):
        np.take(table, cols[t], axis=1, out=pre, mode="clip")
        np.matmul(state, h, out=rec)
        gate += rec[:2 * hid]
        _squash(gate, out=gate)
        gate += 1
        gate *= 0.5
        r *= part
        n += r
        _squash(n, out=n)
        nxt = out[t]
        np.subtract(h, n, out=nxt)
        nxt *= z
        nxt += n
        h = nxt
    return out


def position_probs(model: Model, x: np.ndarray) -> np.ndarray:
    """Label probabilities of every position: time x languages x windows."""
    hid, cols = model.state[0].shape[0], np.ascontiguousarray(x.T).astype(np.intp)
    p = np.matmul(np.ascontiguousarray(model.out[:hid].T), _run(cols, model.table[0], model.state[0], False))
    p += np.matmul(np.ascontiguousarray(model.out[hid:].T), _run(cols, model.table[1], model.state[1], True))
    p += model.bias[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def document_probs(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean of the position probabilities over each whole text."""
    x, counts = windows(texts)
    total = np.zeros((len(x), len(model.langs)))
    length = np.array([len(t) for t in texts], np.int64)
    last = np.cumsum(counts) - 1
    valid = np.full(len(x), WINDOW)
    valid[last[counts > 0]] = (length - (counts - 1) * WINDOW)[counts > 0]
    for lo in range(0, len(x), WIDE):
        p = position_probs(model, x[lo:lo + WIDE])
        short = np.flatnonzero(valid[lo:lo + WIDE] < WINDOW)
        for i in short:
            p[valid[lo + i]:, :, i] = 0
        total[lo:lo + WIDE] = p.sum(axis=0, dtype=np.float64).T
    sums = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(total, axis=0)])
    upper = np.cumsum(counts)
    return (sums[upper] - sums[upper - counts]) / np.maximum(length, 1)[:, None]


def _grad(model: Model, x: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross-entropy over all positions, by
    backpropagation through time."""
    hid, (rows, time) = model.state[0].shape[0], x.shape
    cols = np.ascontiguousarray(x.T).astype(np.intp)
    states, steps = [], []
    for d in (0, 1):
        h = np.zeros((rows, hid), np.float32)
        kept, seen = np.empty((time, rows, hid), np.float32), {}
        for t in (range(time) if d == 0 else range(time - 1, -1, -1)):
            pre, rec = model.table[d][cols[t]], h @ model.state[d]
            gate = 0.5 + 0.5 * _squash(pre[:, :2 * hid] + rec[:, :2 * hid])
            z, r, part = gate[:, :hid], gate[:, hid:], rec[:, 2 * hid:]
            n = _squash(pre[:, 2 * hid:] + r * part)
            seen[t] = (h, z, r, n, part)
            h = n + z * (h - n)
            kept[t] = h
        states.append(kept)
        steps.append(seen)
    both = np.concatenate(states, axis=2).reshape(time * rows, 2 * hid)
    p = both @ model.out + model.bias
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at, gold = np.arange(time * rows), np.tile(label, time)
    loss = float(-np.log(p[at, gold] + 1e-9).mean())
    p[at, gold] -= 1
    p /= time * rows
    d_both = (p @ model.out.T).reshape(time, rows, 2 * hid)
    flat = cols.reshape(-1)
    order = np.argsort(flat, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
    d_table, d_state = [], []
    for d in (0, 1):
        state, carry = np.zeros_like(model.state[d]), np.zeros((rows, hid), np.float32)
        slopes = np.empty((time, rows, 3 * hid), np.float32)
        for t in (range(time - 1, -1, -1) if d == 0 else range(time)):
            h, z, r, n, part = steps[d][t]
            dh = d_both[t, :, d * hid:(d + 1) * hid] + carry
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dn * part * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            slopes[t] = np.concatenate([dz, dr, dn], axis=1)
            rec = np.concatenate([dz, dr, dn * r], axis=1)
            state += h.T @ rec
            carry = dh * z + rec @ model.state[d].T
        table = np.zeros_like(model.table[d])
        table[flat[order][heads]] = np.add.reduceat(slopes.reshape(-1, 3 * hid)[order], heads, axis=0)
        d_table.append(table)
        d_state.append(state)
    return [*d_table, *d_state, both.T @ p, p.sum(axis=0)], loss


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS) -> Model:
    """Fit on windows (the first ``WINDOW`` bytes of each text) by Adam."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(SEED)

    def init(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    model = Model([init(256, 3 * hidden, scale=0.3) for _ in "fb"],
                  [init(hidden, 3 * hidden, scale=hidden**-0.5) for _ in "fb"],
                  init(2 * hidden, max(1, len(langs)), scale=0.3), np.zeros(max(1, len(langs)), np.float32), langs)
    keep = [i for i, t in enumerate(texts) if t]
    if len(langs) < 2 or not keep:
        return model
    x = np.stack([windows([texts[i][:WINDOW]])[0][0] for i in keep])
    label = np.array([langs.index(labels[i]) for i in keep])
    first = [np.zeros_like(a) for a in model.arrays()]
    second = [np.zeros_like(a) for a in model.arrays()]
    n = 0
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(x) // BATCH))) if epochs else 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = RATE * (1 - epoch / epochs)
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            grads, _ = _grad(model, x[pick], label[pick])
            n += 1
            for a, g, m, v in zip(model.arrays(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return model


# First and last letters of scripts.
SCRIPTS = [(0x3b1, 0x3c9), (0x430, 0x44f), (0x5d0, 0x5ea), (0x621, 0x64a), (0x905, 0x939), (0xe01, 0xe2e),
           (0x3041, 0x3096), (0x4e00, 0x9fa5), (0xac00, 0xd7a3)]


def noise(parts: list[str], n: int) -> list[bytes]:
    """``n`` windows that are in no language, made of and beside ``parts``."""
    if not parts:
        return []
    rng = np.random.default_rng(SEED)
    used = [sum(any(lo <= ord(c) <= hi for c in p) for p in parts) > 0.01 * len(parts) for lo, hi in SCRIPTS]
    scripts = [x for x, u in zip(SCRIPTS, used) if not u]
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef",
                 "abcdefghijklmnopqrstuvwxyz", "asdfghjkl;qwertyuiop", "0123456789.,;:-_#*/()[]|<>=+ "]
    out = []
    for i in range(n):
        kind = i % 12
        if kind < 6:
            text = "".join(rng.permutation(list(parts[int(rng.integers(len(parts)))])))
        elif kind < 11 or not scripts:
            letters = list(alphabets[(kind - 6) % len(alphabets)])
            text = "".join(rng.choice(letters, WINDOW))
            if rng.random() < 0.5:
                text = _spaced(text, rng)
        else:
            lo, hi = scripts[int(rng.integers(len(scripts)))]
            text = _spaced("".join(map(chr, rng.integers(lo, hi + 1, WINDOW))), rng)
        out.append(text.encode()[:WINDOW])
    return out


def _spaced(text: str, rng: np.random.Generator) -> str:
    """``text`` with a space in place of about one character in seven."""
    return "".join(" " if gap else c for c, gap in zip(text, rng.random(len(text)) < 1 / 7))


def fit(docs: DataFrame, sample_windows: int = SAMPLE_WINDOWS, reject: bool = False) -> Model:
    """Train on a bounded sample of ``docs`` (``doc_id, text, lang``); with
    ``reject`` also on noise, as many windows as a language has."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), "text", "lang").where(
        (remainder("doc_id") != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n_docs = {r["lang"]: r["count"] for r in
              docs.where((remainder("doc_id") != 0) & F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    if not n_docs:
        return train([], [])
    quota = sample_windows / len(n_docs)        # windows of one language
    by_lang = [(F.lit(k), min(1.0, quota / n), min(MOST_WINDOWS, max(1, int(quota / n)))) for k, n in
               sorted(n_docs.items())]
    share = F.create_map(*[x for k, p, _ in by_lang for x in (k, F.lit(p))])[F.col("lang")]
    each = F.create_map(*[x for k, _, w in by_lang for x in (k, F.lit(w))])[F.col("lang")]
    pick = F.xxhash64(F.lit(3), F.col("doc_id").cast("string"))
    place = F.pmod(F.xxhash64(F.lit(4), F.col("doc_id").cast("string"), F.col("nth")), F.length("text")) + 1
    sample = (rows.where(F.pmod(pick, F.lit(1 << 30)) < share * (1 << 30))
              .withColumn("nth", F.explode(F.sequence(F.lit(1), each)))
              .select("doc_id", "lang", F.substring(
                  "text", F.greatest(F.lit(1), F.least(place, F.length("text") - WINDOW + 1)).cast("int"),
                  F.lit(WINDOW)).alias("part"))
              .limit(2 * sample_windows).collect())
    got = sorted((str(r["doc_id"]), r["part"], r["lang"]) for r in sample)
    texts, labels = [p.encode()[:WINDOW] for _, p, _ in got], [lang for _, _, lang in got]
    if reject:
        extra = noise([p for _, p, _ in got], -(-len(got) // len(n_docs)))
        texts, labels = texts + extra, labels + [REJECT] * len(extra)
    return train(texts, labels)


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` for every row of ``docs`` (``key, text``)."""
    und = not model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(x or "").encode() if has else b""
                    for x, has in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            langs, scores = [], []
            for lo, hi in slices([len(x) for x in data]):
                probs = document_probs(model, data[lo:hi]) if not und else np.zeros((hi - lo, 1))
                best = probs.argmax(axis=1)
                for i, text in enumerate(data[lo:hi]):
                    langs.append(UND if und or not text else model.langs[best[i]])
                    scores.append(1.0 if not text else float(min(1.0, probs[i, best[i]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kind = dict(docs.select(key).dtypes)[key]
    return map_arrow(
        docs.select(key, "text", letters.alias("letters")), run, f"`{key}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    model = model or fit(docs)
    return (predict(docs.select("doc_id", "text"), model)
            .select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
                    "lang_pred", "score"))


def accepted(docs: DataFrame, over_chance: float = OVER_CHANCE, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a letter and
    a language: a probability of noise of ``MOST_NOISE`` at most, and for one
    language ``over_chance`` times an equal share of the rest at least.  A text
    in two languages scores far above that."""
    model = model or fit(docs, reject=True)
    at = docs.columns.index("text")
    letter = "__llm_letter"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([x != REJECT for x in model.langs], bool)
        for batch in batches:
            rows, has = batch.select(range(batch.num_columns - 1)), batch.column(batch.num_columns - 1).to_pylist()
            data = [(x or "").encode() if ok else b"" for x, ok in zip(rows.column(at).to_pylist(), has)]
            for lo, hi in slices([len(x) for x in data]):
                part, good = data[lo:hi], np.zeros(hi - lo, bool)
                if langs.any():
                    probs = document_probs(model, part)
                    bad = probs[:, ~langs].sum(axis=1)
                    good = (bad <= MOST_NOISE) & (probs[:, langs].max(axis=1) >= over_chance * (1 - bad) / langs.sum()
                                                  if langs.sum() > 1 else True)
                yield rows.slice(lo, hi - lo).filter(pa.array(good & np.array([len(x) > 0 for x in part])))

    marked = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return map_arrow(marked, run, docs.schema)
