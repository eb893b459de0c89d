import random
from collections import defaultdict

import numpy as np
import pytest

from upkeep.llm import components, jaccard

RNG = random.Random(4)


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute(docs):
    sets = {i: shingles(t or "") for i, t in docs}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and both and 5 * both >= 4 * len(sets[a] | sets[b]):
                links[a].add(b)
    out = {}
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (min(seen), min([b for b in links[a] if sets[b] == sets[a]] + [a]), len(links[a]))
    return out


def corpus():
    docs, n = [], 0
    for size in (12, 40, 150):
        for _ in range(8):
            base = [f"w{RNG.randrange(3000)}" for _ in range(size)]
            for _ in range(RNG.choice([1, 2, 9])):
                w = list(base)
                for _ in range(RNG.choice([0, 0, 1, 1, 3])):
                    w[RNG.randrange(size)] = f"e{RNG.randrange(3000)}"
                docs.append((n, " ".join(w)))
                n += 1
    return docs + [(n, ""), (n + 1, "one two"), (n + 2, "one two"), (n + 3, None), (n + 4, "one  two\n")]


@pytest.mark.parametrize("block", [jaccard.BLOCK_SHINGLES, 400])
def test_every_link_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    docs = corpus()
    out = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"]) for r in jaccard.join_classes(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()}
    assert out == brute(docs)


def test_posterior_prunes_by_the_beta_tail():
    assert jaccard.posterior(128, 128) > 0.999 and jaccard.posterior(16, 128) < 1e-40
    # Beta(1, 1) after nothing: 1 - threshold.
    assert abs(jaccard.posterior(0, 0) - 0.2) < 1e-12
    least = jaccard.least_matches()
    assert least == sorted(least) and all(jaccard.posterior(m - 1, n) < jaccard.TOLERANCE for m, n in
                                          zip(least, range(16, 129, 16)) if m)


def test_pruned_pairs_are_far_apart():
    sets = [np.unique(RNG.choices(range(10**9), k=200)).astype(np.uint64) for _ in range(30)]
    near = [np.unique(np.concatenate([s[:185], s[185:] + np.uint64(7)])) for s in sets]
    a, b = (np.stack([jaccard.signature(x) for x in y]) for y in (sets, near))
    i, j = jaccard.unpruned_pairs(a, b, False, jaccard.least_matches())
    assert set(range(30)) == {x for x, y in zip(i, j) if x == y} and len(i) == 30
    assert jaccard.overlaps(i, j, sets, near).tolist() == [len(np.intersect1d(sets[x], near[y])) for x, y in zip(i, j)]


def test_components_by_union(spark):
    edges = [(a, a + 1) for a in range(100, 140)] + [(1, 2), (2, 3), (9, 1), (50, 50), (60, 61), (61, 60), (7, 300)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{a: 100 for a in range(100, 141)}, 1: 1, 2: 1, 3: 1, 9: 1, 60: 60, 61: 60, 7: 7, 300: 7}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def brute_rows(rows):
    """The same by rows: (doc_id, class_id, copy_id, n_links) of every row."""
    numbered = list(enumerate(t for _, t in rows))
    sets = {i: shingles(t or "") for i, t in numbered}
    ids = lambda found: min([rows[i][0] for i in found if rows[i][0] is not None], default=None)
    near = {i: {j for j in sets if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
            for i in sets}
    out = []
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], ids(seen), ids({i} | {j for j in near[i] if sets[j] == sets[i]}), len(near[i])))
    return out


def rows_with_odd_ids():
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    return [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "c d e f g h"), (1, a), (1, a), (None, c), (None, c),
            (None, c + " z"), (None, "own words of a row"), (7, c + " y"), (None, None), (None, ""), (8, " "), (1, c[:50]),
            (None, "p q r s t u v"), (None, "p q r s t u v")]


@pytest.mark.parametrize("bucket", [jaccard.BUCKET_ROWS, 2])
def test_rows_that_reuse_or_lack_a_doc_id(spark, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", bucket)     # larger buckets are tied without a comparison
    rows = rows_with_odd_ids()
    out = [tuple(r) for r in jaccard.join_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(out, key=str) == sorted(brute_rows(rows), key=str)


def test_one_row_of_each_group_stays(spark):
    rows = rows_with_odd_ids()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    out = [(r["doc_id"], r["text"]) for r in jaccard.deduplicated(docs).collect()]
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    want = [(1, a), (1, b), (4, "c d e f g h"), (7, c + " y"), (None, "own words of a row"), (None, None), (None, ""),
            (8, " "), (1, c[:50]), (None, "p q r s t u v")]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_unlike_texts_are_not_tied(spark):
    """A chain of texts at likeness about 0.35, many of which meet in a band:
    nothing of it is left to compare exactly."""
    rng, n = random.Random(11), 400
    words = [f"w{rng.randrange(10**6)}" for _ in range(100 * n + 200)]
    # Neighbours share half of their 200 words: likeness 98 / 294.
    docs = spark.createDataFrame([(i, " ".join(words[100 * i:100 * i + 200])) for i in range(n)], "doc_id bigint, text string")
    sigs = jaccard.map_arrow(jaccard._rows(docs), jaccard._signatures, "doc_id bigint, text_hash bigint, "
                             "set_key binary, n_shingles bigint, sig binary")
    classes = jaccard.shared_table(sigs.selectExpr("doc_id as cid", "sig"), "test-classes")
    rows = classes.collect()
    bands = defaultdict(list)
    for r in rows:
        for k in range(32):
            bands[k, r["sig"][16 * k:16 * k + 16]].append(r["cid"])
    assert sum(len(x) > 1 for x in bands.values()) > n / 4         # the bands alone tie long chains
    assert jaccard._candidates(classes).count() == 0


def test_pairs_inside_buckets():
    sizes = np.array([3, 1, 4, 2])
    for limit in (1, 5, 1 << 20):
        jaccard.PAIRS, before = limit, jaccard.PAIRS
        pairs = [(int(x), int(y)) for i, j in jaccard.bucket_pairs(sizes) for x, y in zip(i, j)]
        jaccard.PAIRS = before
        assert sorted(pairs) == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7), (8, 9)]
