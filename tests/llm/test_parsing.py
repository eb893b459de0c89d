import hashlib
import random

import numpy as np
import xxhash

from upkeep.llm import parsing

RNG = random.Random(6)


def text(n):
    return " ".join(RNG.choice(["alpha", "beta", "gam", "delta", "eps", "zeta", "eta", "theta"]) for _ in range(n))


def names(t):
    x = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
    first, out = np.array([0]), []
    for _ in range(3):
        x, first = parsing.next_level(x, first)
        out.append(x)
    return out


def test_inner_phrases_do_not_depend_on_the_offset():
    for _ in range(20):
        inner = text(80)
        a, b = names(text(9) + inner + text(5)), names("x" * RNG.randrange(1, 9) + inner)
        alone = names(inner)
        for level, (p, q, r) in enumerate(zip(alone, a, b)):
            edge = 8
            assert set(p[edge:-edge].tolist()) <= set(q.tolist()) & set(r.tolist()) or level == 2


def test_labels_of_neighbours_differ():
    x = np.array(RNG.choices(range(2**40), k=3000), np.uint64)
    x = x[np.r_[True, x[1:] != x[:-1]]]
    label = parsing.labels(x, np.array([0, 100, 101, 2000]))
    inside = np.ones(len(x) - 1, bool)
    inside[[99, 100, 1999]] = False
    assert label.max() < 8 and (label[1:] != label[:-1])[inside].all()


def test_a_text_has_one_sketch_whatever_stands_beside_it():
    texts = ["", "a", "aa", "aaaaaaaaaaaaaaaaaaaa", "ab" * 30, "\U0001F600", text(30), text(200), "x", text(3)]
    together = parsing.sketches(texts)
    assert [s.tolist() for s in together] == [parsing.sketches([t])[0].tolist() for t in texts]


def test_likeness_by_brute_force():
    for _ in range(100):
        a, b = (np.unique(RNG.choices(range(90), k=RNG.choice([3, 60]))).astype(np.uint32)[:parsing.SKETCH] for _ in "ab")
        union = sorted(set(a.tolist()) | set(b.tolist()))[:parsing.SKETCH]
        assert parsing.likeness(a, b) == sum(x in a and x in b for x in union) / len(union)
    empty = np.zeros(0, np.uint32)
    assert parsing.likeness(empty, empty) == 1 and parsing.likeness(empty, a) == 0


def test_edits_and_order(spark, monkeypatch):
    monkeypatch.setattr(parsing, "ROWS_PER_PART", 7)
    rows = [(RNG.randrange(10**6), text(RNG.choice([0, 1, 40, 90]))) for _ in range(100)]
    rows = list({i: (i, t) for i, t in rows}.values())
    out = {r["doc_id"]: r for r in parsing.compare_edits(
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()}
    order = sorted(rows)
    assert len(out) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        changed = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        own, new, nxt = parsing.sketches([t, changed, following])
        r = out[i]
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (parsing.written(own), parsing.written(new))
        assert (r["near_edited"], r["near_next"]) == (parsing.likeness(own, new), parsing.likeness(own, nxt))
    far = [r for i, r in out.items() if r["n_chars"] > 150]
    assert np.mean([r["near_edited"] for r in far]) > 0.45


def test_ties_have_one_order(spark):
    rows = [(1, "b" * 40), (1, "a" * 40), (1, "b" * 40), (None, "c" * 40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    a, b = (sorted(map(str, parsing.compare_edits(frame.repartition(n)).collect())) for n in (1, 3))
    assert a == b and len(a) == 4
    assert {r["doc_id"]: r["fingerprint"] for r in parsing.fingerprints(frame).collect()}[None] == parsing.written(
        parsing.sketches(["c" * 40])[0])


M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & M64
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & M64
    return x ^ (x >> 33)


def plain_toss(x, left):
    """Twice the lowest bit in which two symbols differ, plus the symbol's own bit there."""
    bit = ((x ^ left) & -(x ^ left)).bit_length() - 1
    return 2 * bit + (x >> bit & 1)


def plain_level(x):
    runs = []
    for c in x:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    x = [c if n == 1 else plain_mix((c * 0x9E3779B97F4A7C15 + n) & M64) for c, n in runs]
    label = x
    for _ in range(3):
        label = [plain_toss(c, label[i - 1] if i else c ^ 1) for i, c in enumerate(label)]
    starts = [i for i in range(len(x)) if not i or (i + 1 < len(x) and label[i - 1] < label[i] > label[i + 1])]
    radix = [pow(0xA0761D6478BD642F, k, 1 << 64) for k in range(64)]
    return [plain_mix(sum(plain_mix(c) * radix[k & 63] for k, c in enumerate(x[lo:hi])) & M64)
            for lo, hi in zip(starts, starts[1:] + [len(x)])]


def plain_fingerprint(t):
    x, ranks = [ord(c) for c in t], set()
    for level in range(3 if t else 0):
        x = plain_level(x)
        ranks |= {plain_mix(name) >> (24 + 3 * level) for name in x}
    return "".join(f"{r:010x}" for r in sorted(ranks)[:48])


def test_fingerprints_by_a_plain_version():
    texts = ["", "a", "ab", "aa", "a" * 50, "ab" * 40, "\U0001F600é中" * 9, "\x00\x01" * 5]
    texts += [text(n) for n in (1, 2, 5, 9, 30, 200)] + ["".join(RNG.choice("abc ") for _ in range(n)) for n in (3, 63, 64, 65, 500)]
    assert [parsing.written(s) for s in parsing.sketches(texts)] == [plain_fingerprint(t) for t in texts]


def test_one_rule_for_every_length():
    """Dropping the last character costs less the longer a text is, without a step."""
    mean = []
    for n in (40, 60, 62, 63, 64, 65, 66, 68, 80, 120):
        whole = [text(40)[:n] for _ in range(150)]
        pairs = zip(parsing.sketches(whole), parsing.sketches([t[:-1] for t in whole]))
        mean.append(np.mean([parsing.likeness(a, b) for a, b in pairs]))
    assert min(mean[1:]) > 0.7 and all(b > a - 0.05 for a, b in zip(mean, mean[1:]))


def test_a_hot_doc_id_is_many_parts(spark, monkeypatch):
    monkeypatch.setattr(parsing, "ROWS_PER_PART", 10)
    rows = [(None, f"none {i}") for i in range(90)] + [(7, f"seven {i}") for i in range(90)] + [(i, f"t {i}") for i in range(120)]
    RNG.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sizes = [r["count"] for r in parsing.in_order(frame).where("not last").groupBy("part").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 60

    def key(row):
        k = xxhash.xxh64_intdigest(row[1], seed=42)
        return (row[0] is not None, row[0] or 0, k - (1 << 64) if k >> 63 else k)

    order = sorted(rows, key=key)
    want = sorted(hashlib.sha256(parsing.edited(t, f).encode()).hexdigest()
                  for (_, t), (_, f) in zip(order, order[1:] + order[:1]))
    assert sorted(r["edited_sha256"] for r in parsing.compare_edits(frame).collect()) == want


def test_part_numbers_by_counting():
    quantiles = [3.0, 5.0, 5.0, 5.0, 8.0, 8.0]
    bounds = parsing.part_bounds(quantiles, 3)
    assert len(bounds) == 8
    ids = [RNG.choice([None, 1, 3, 4, 5, 5, 7, 8, 9]) for _ in range(400)]
    keys = [RNG.randrange(-1 << 63, 1 << 63) for _ in ids]
    order = lambda i, k: (i is not None, i or 0, k)
    want = [sum(order(*b) <= order(i, k) for b in bounds) for i, k in zip(ids, keys)]
    # A first row of known ids stands behind all parts of the null ones.
    want = [n if i is not None else min(n, 2) for n, i in zip(want, ids)]
    none = np.array([i is None for i in ids])
    got = parsing.part_numbers(np.array([i or 0 for i in ids]), none, np.array(keys), bounds).tolist()
    assert got == want
