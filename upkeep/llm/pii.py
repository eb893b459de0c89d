"""Personal data by fixed rules and a skip-chain conditional random field (operator 10).

Base spans come from fixed patterns.  The field adds spans that the patterns
miss but that repeat, or resemble, what they find elsewhere in the document.

Nodes are the white-space delimited tokens that hold a digit or ``@``; every
other token has the label *none* for certain, so leaving it out cuts the chain
exactly there.  Chain edges join neighbouring nodes.  Skip edges join a token
to the next one in the document with the same characters, or with the same
digits or mail domain, at any distance: a linear number of edges that connects
all occurrences.  Loopy sum-product message passing over all documents of a
slice at once gives the label probabilities.

The weights are trained on a bounded sample (``SAMPLE_DOCS`` documents of at
most ``SAMPLE_CHARS`` characters that hold a digit or ``@``), labelled by the
base patterns, by gradient steps on the difference between observed and
expected (message passing) counts.  Only token features reach the driver.

Defined cases: a null text is an empty one; a null doc_id is kept; repeated
rows are judged alike; an empty table gives an empty result (and an untrained
field, which adds nothing); texts are never cut and cost time in proportion to
their length, whatever they hold; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import hash_sample, map_arrow, slices

KINDS = ["email", "ip", "card", "phone"]
K = len(KINDS) + 1
UNKNOWN = K
SAMPLE_DOCS = 6000
SAMPLE_CHARS = 20_000
ROUNDS = 8
STEPS = 150
RATE = 0.5
DECAY = 1e-3
CONFIDENT = 0.9
LEAST_DIGITS = 7
SLICE_CHARS = 4 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# A match begins a run of digits: from inside the run the pattern would go the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[ \t-\r]")
_EDGE = re.compile(r"[A-Za-z0-9+(]")
_REAR = re.compile(r"[A-Za-z0-9)](?=[^A-Za-z0-9)]*\Z)")
_DIGITS = re.compile(r"[^0-9]+")

# Where the sample has few skip edges, their weights stay near these: equal
# tokens mostly share a label, similar ones often do.
PRIOR = np.stack([np.zeros((K, K)), 3 * np.eye(K), 1.5 * np.eye(K)])

Span = tuple[int, int, int]     # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the mail pattern, found from each ``@`` so that long
    texts of mail characters cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping for each kind."""
    out: list[Span] = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def unsure_spans(text: str) -> list[tuple[int, int]]:
    """Matches that the patterns drop because they run into further digits: what
    they hold may well be personal data, so its tokens get no training label.
    In order; overlapping ones are one."""
    found = [m.span() for m in _CARD.finditer(text) if len(_DIGITS.sub("", m[0])) > 19]
    if "+" in text:
        found += [m.span() for m in _PHONE.finditer(text) if len(_DIGITS.sub("", m[0])) > 15]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start < out[-1][1]:
            start, end = out[-1][0], max(end, out.pop()[1])
        out.append((start, end))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of every white-space delimited token with a digit or ``@``."""
    out, done, n = [], 0, len(text)
    m = _MARK.search(text)
    while m:
        at = m.start()
        start = done + max((text.rfind(c, done, at) - done + 1 for c in " \n\t\r\x0b\x0c"), default=0)
        end = _SPACE.search(text, at)
        done = end.start() if end else n
        out.append((max(start, 0), done))
        m = _MARK.search(text, done)
    return out


# Features of a token; each is 0 or 1.
FEATURES = ["always", "at", "at_dot", "letters", "plus_first", "paren", "hyphen", "quad", "quad_255", "luhn",
            "dots", "digits_1_3", "digits_4_6", "digits_7_8", "digits_9_11", "digits_12_15", "digits_16_19",
            "digits_20", "before_node", "after_node", "before_plus", "sum_luhn", "hex_letters", "colon_slash"]


class Graph:
    """Nodes and edges of the documents of a slice."""

    def __init__(self) -> None:
        self.features: list[bytearray] = []
        self.gold: list[int] = []           # UNKNOWN: not for training
        self.spans: list[tuple[int, int, int]] = []     # document, core start, core end
        self.edges: list[tuple[int, int, int]] = []     # node, node, type: chain, same, similar

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        cores: list[str] = []
        unsure, u = unsure_spans(text), 0
        first, previous_end, b = len(self.features), -2, 0
        for start, end in tokens(text):
            word = text[start:end]
            core, s = word, start
            if len(word) <= 256:
                head, tail = _EDGE.search(word), _REAR.search(word)
                if head and tail and head.start() < tail.end():
                    core, s = word[head.start():tail.end()], start + head.start()
            e = s + len(core)
            beside = previous_end >= 0 and text[previous_end:start].strip(" \t\n\x0b\x0c\r") == ""
            self.features.append(bytearray(self._describe(core, _DIGITS.sub("", core), beside,
                                                          text[max(0, s - 1):s] == "+")))
            while b < len(base) and base[b][2] <= s:
                b += 1
            gold = 0
            for x in base[b:b + 4]:
                if x[0] < e and x[2] > s and 2 * (min(e, x[2]) - max(s, x[0])) >= e - s:
                    gold = x[1] + 1
                    break
            while u < len(unsure) and unsure[u][1] <= s:
                u += 1
            if not gold and u < len(unsure) and unsure[u][0] < e:
                gold = UNKNOWN
            self.gold.append(gold)
            self.spans.append((doc, s, e))
            if beside:
                node = first + len(cores)
                self.features[node - 1][FEATURES.index("after_node")] = 1
                self.edges.append((node - 1, node, 0))
            cores.append(core.lower())
            previous_end = end
        self._skip(first, cores)

    def _skip(self, first: int, cores: list[str]) -> None:
        """Edges to the next token with the same characters, or else with the
        same digits or mail domain.  Short numbers count with a neighbour."""
        same: dict[str, int] = {}
        similar: dict[str, int] = {}
        before, after = FEATURES.index("before_node"), FEATURES.index("after_node")
        for i, core in enumerate(cores):
            node, digits = first + i, _DIGITS.sub("", core)
            key = core
            if len(digits) < 4 and "@" not in core:
                key = (f"{core} {cores[i + 1]}" if self.features[node][after] else
                       f"{cores[i - 1]} {core} " if self.features[node][before] else "")
            alike = core.rpartition("@")[2] if "@" in core else digits if len(digits) >= LEAST_DIGITS else ""
            last = same.get(key) if key else None
            if last is not None:
                self.edges.append((last, node, 1))
            elif alike and alike in similar:
                self.edges.append((similar[alike], node, 2))
            if key:
                same[key] = node
            if alike:
                similar[alike] = node

    @staticmethod
    def _describe(core: str, digits: str, beside: bool, after_plus: bool) -> list[int]:
        n = len(digits)
        quad = bool(_IP.fullmatch(core))
        at = "@" in core
        letters = any(c.isalpha() for c in core)
        return [1, at, at and "." in core.rpartition("@")[2], letters, core[:1] == "+", "(" in core, "-" in core,
                quad, quad and all(len(p) < 4 and int(p) <= 255 for p in core.split(".")),
                12 <= n <= 19 and not letters and luhn(digits), core.count(".") == 1, 1 <= n <= 3, 4 <= n <= 6,
                7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n >= 20, beside, 0, after_plus,
                12 <= n <= 19 and luhn(digits), letters and all(c in "0123456789abcdef" for c in core),
                ":" in core or "/" in core]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.frombuffer(b"".join(self.features), np.int8).reshape(-1, len(FEATURES)),
                np.array(self.edges, np.int64).reshape(-1, 3))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def propagate(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS):
    """Loopy sum-product in logarithms, damped by half.

    Returns node probabilities and, for each edge, the two beliefs without the
    message that came over this edge."""
    i, j, kind = edges[:, 0], edges[:, 1], edges[:, 2]
    right, left = np.zeros((len(edges), K)), np.zeros((len(edges), K))
    potential = pair[kind]
    for step in range(rounds + 1):
        belief = unary.copy()
        np.add.at(belief, j, right)
        np.add.at(belief, i, left)
        from_i, from_j = belief[i] - left, belief[j] - right
        if step == rounds or not len(edges):
            break
        new_right = _logsum(from_i[:, :, None] + potential, 1)
        new_left = _logsum(from_j[:, None, :] + potential, 2)
        right = 0.5 * right + 0.5 * (new_right - _logsum(new_right, 1)[:, None])
        left = 0.5 * left + 0.5 * (new_left - _logsum(new_left, 1)[:, None])
    prob = np.exp(belief - _logsum(belief, 1)[:, None]) if len(belief) else belief
    return prob, from_i, from_j


def train(features: np.ndarray, edges: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features (features x labels) and of the three edge types."""
    weight, pair = np.zeros((len(FEATURES), K)), PRIOR.copy()
    if not len(features):
        return weight, pair
    sure = gold < K
    want = np.eye(K)[np.where(sure, gold, 0)]
    both = sure[edges[:, 0]] & sure[edges[:, 1]]
    kind = edges[both, 2]
    seen = np.zeros_like(pair)
    np.add.at(seen, (kind, gold[edges[both, 0]], gold[edges[both, 1]]), 1)
    per_type = np.maximum(np.bincount(kind, minlength=3), 1)[:, None, None]
    # Each label counts by the root of its frequency, so that rare kinds are learned.
    share = np.maximum(np.bincount(gold[sure], minlength=K), 1) / len(gold)
    scale = np.where(sure, (1 / np.sqrt(share))[np.where(sure, gold, 0)], 0)
    scale /= max(scale.mean(), 1e-9)
    speed_w, speed_p = np.full_like(weight, 1e-6), np.full_like(pair, 1e-6)
    for _ in range(STEPS):
        prob, a, b = propagate(features @ weight, edges, pair, 4)
        grad = features.T @ ((want - prob) * scale[:, None]) / len(features) - DECAY * weight
        joint = (a[:, :, None] + b[:, None, :] + pair[edges[:, 2]])[both]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected = np.zeros_like(pair)
        np.add.at(expected, kind, joint)
        grad_p = (seen - expected) / per_type - DECAY * (pair - PRIOR)
        grad_p[1:] = (grad_p[1:] + grad_p[1:].transpose(0, 2, 1)) / 2
        speed_w += grad**2
        speed_p += grad_p**2
        weight += RATE * grad / np.sqrt(speed_w)
        pair += RATE / 2 * grad_p / np.sqrt(speed_p)
    return weight, pair


def _meets(covered: dict[int, tuple[list[int], list[int]]], doc: int, base: dict[int, list[Span]], s: int, e: int) -> bool:
    """Whether a base span of ``doc`` overlaps (s, e); ``covered`` keeps the
    starts of its base spans and the farthest end up to each."""
    if doc not in covered:
        spans = base.get(doc, [])
        covered[doc] = ([x[0] for x in spans], list(accumulate((x[2] for x in spans), max)))
    starts, ends = covered[doc]
    k = bisect_left(starts, e)
    return k > 0 and ends[k - 1] > s


def added_spans(graph: Graph, prob: np.ndarray, base: dict[int, list[Span]], texts: list[str]) -> dict[int, list[Span]]:
    """Runs of neighbouring nodes with one confident label, away from base spans."""
    chained = {b for a, b, t in graph.edges if t == 0}
    label = np.where(prob.max(axis=1) >= CONFIDENT, prob.argmax(axis=1), 0) if len(prob) else []
    out: dict[int, list[Span]] = {}
    run: list[int] = []
    covered: dict[int, tuple[list[int], list[int]]] = {}

    def close() -> None:
        if run:
            doc, s, e = graph.spans[run[0]][0], graph.spans[run[0]][1], graph.spans[run[-1]][2]
            kind, word = int(label[run[0]]) - 1, texts[doc][s:e]
            enough = "@" in word if kind == 0 else sum(c in "0123456789" for c in word) >= LEAST_DIGITS
            if enough and not _meets(covered, doc, base, s, e):
                out.setdefault(doc, []).append((s, kind, e))
            run.clear()

    for node in np.flatnonzero(label):
        node = int(node)
        if not (run and node in chained and run[-1] == node - 1 and label[node] == label[run[0]]):
            close()
        run.append(node)
    close()
    return out


Model = tuple[np.ndarray, np.ndarray]


def annotate(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    graph, base = Graph(), {}
    for doc, text in enumerate(texts):
        if _MARK.search(text):
            base[doc] = base_spans(text)
            graph.add(doc, text, base[doc])
    added: dict[int, list[Span]] = {}
    if graph.features and np.any(model[0]):
        features, edges = graph.arrays()
        unary = [features[lo:lo + 65536].astype(float) @ model[0] for lo in range(0, len(features), 65536)]
        prob, _, _ = propagate(np.concatenate(unary), edges, model[1])
        added = added_spans(graph, prob, base, texts)
    return [(base.get(i, []), added.get(i, [])) for i in range(len(texts))]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of ``docs`` (``doc_id, text``)."""
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                graph = Graph()
                graph.add(0, text, base_spans(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b"".join(graph.features)], pa.binary()),
                     pa.array([graph.arrays()[1].astype("<i4").tobytes()], pa.binary()),
                     pa.array([bytes(graph.gold)], pa.binary())], ["features", "edges", "gold"])

    usable = (F.length("text") <= sample_chars) & F.col("text").rlike("[0-9@]")
    sample = hash_sample(docs.select("doc_id", "text"), sample_docs, salt=10).where(usable).select("text")
    rows = map_arrow(sample, nodes, "features binary, edges binary, gold binary").collect()
    rows = sorted((bytes(r.features), bytes(r.edges), bytes(r.gold)) for r in rows)
    features, edges, gold, n = [], [], [], 0
    for f, e, g in rows:
        features.append(np.frombuffer(f, np.int8).reshape(-1, len(FEATURES)))
        edges.append(np.frombuffer(e, "<i4").reshape(-1, 3) + np.array([n, n, 0]))
        gold.append(np.frombuffer(g, np.uint8))
        n += len(g)
    if not n:
        return np.zeros((len(FEATURES), K)), PRIOR.copy()
    return train(np.concatenate(features).astype(float), np.concatenate(edges).astype(np.int64),
                 np.concatenate(gold).astype(np.int64))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _structs(spans: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, base, added``: arrays of (kind, start, end) in code points, end
    exclusive, by start and then kind, for every row of ``docs``."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in slices([len(x) for x in texts], SLICE_CHARS):
                found = annotate(texts[lo:hi], model)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                    pa.array([_structs(b) for b, _ in found], _SPANS),
                    pa.array([_structs(a) for _, a in found], _SPANS)], ["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id bigint, base {spans}, added {spans}")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in angle brackets;
    overlapping spans become one, named by the first."""
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s < done:
            if e > done:
                done = e
            continue
        out += [text[done:s], f"<{KINDS[k]}>"]
        done = e
    return "".join([*out, text[done:]])


def mask_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` (if it
    is there) recounted; every other column and every row stays."""
    model = model or fit(docs)
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices([len(x) if x else 0 for x in batch.column(at).to_pylist()], SLICE_CHARS):
                part = batch.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                found = annotate([x or "" for x in texts], model)
                new = [None if x is None else masked(x, b + a) for x, (b, a) in zip(texts, found)]
                cols = list(part.columns)
                cols[at] = pa.array(new, cols[at].type)
                if count is not None:
                    cols[count] = pa.array([None if x is None else len(x) for x in new], cols[count].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return map_arrow(docs, run, docs.schema)


