import itertools
import random

from upkeep.llm import packing

RNG = random.Random(2)


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_boundaries_by_brute_force():
    for _ in range(40):
        histogram = {RNG.randrange(1, 40): RNG.randrange(1, 9) for _ in range(RNG.randrange(1, 9))}
        k = RNG.randrange(1, 5)
        top = max(histogram)
        best = min(padding(histogram, [*c, top]) for n in range(k) for c in
                   itertools.combinations(sorted(set(histogram) - {top}), n))
        bounds = packing.best_boundaries(histogram, k)
        assert len(bounds) <= k and bounds == sorted(bounds) and padding(histogram, bounds) == best
    assert packing.best_boundaries({}) == []


def test_every_token_in_one_piece_and_batches_within_budget(spark):
    rows = [(i, RNG.choice([0, 1, 7, 30, 64, 65, 200])) for i in range(400)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 64, 4, 256).collect()
    pieces, batches = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        if r["n_tokens"]:
            batches.setdefault((r["bucket_tokens"], r["batch"]), []).append((r["slot"], r["n_tokens"]))
    for i, n in rows:
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at and size <= 64
            at += size
        assert at == n
    full = {}
    for (bucket, batch), got in batches.items():
        assert sorted(s for s, _ in got) == list(range(len(got)))
        assert len(got) * bucket <= 256 and all(n <= bucket for _, n in got)
        full.setdefault(bucket, []).append((batch, len(got)))
    for bucket, got in full.items():        # only the last batch of a bucket may be short
        assert [b for b, _ in sorted(got)] == list(range(len(got)))
        assert all(n == 256 // bucket for _, n in sorted(got)[:-1])


def plain_units(text):
    """Tokens character by character: syllables alone, other runs of a word cut after eight."""
    n = run = 0
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            run = 0
        elif any(a <= c <= b for a, b in ("\u2e80\u9fff", "\ua960\ua97f", "\uac00\ud7ff", "\uf900\ufaff", "\ufe30\ufe4f")):
            n, run = n + 1, 0
        else:
            n += run == 0
            run = (run + 1) % 8
    return n


TEXTS = ["", "  \n", "one two", "x" * 1000, "昨日の夕方、市民 abc 한국어" * 40, "a b\n\tc  " * 300, "  lead " + "word " * 100 + " \t",
         "\U0001F600" * 50, "mixedかなwords 12345678901234567 é\u00a0è\u2003z"]


def test_tokens_by_a_plain_count(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs).collect()}
    assert got == {i: plain_units(t) for i, t in enumerate(TEXTS)} | {99: 0}


def test_pieces_make_the_text_again(spark):
    rows = list(enumerate(TEXTS)) + [(None, "one of many rows " * 30 + str(i)) for i in range(40)] + [(5, "reused " * 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = packing.pack(packing.token_counts(docs, keep_text=True, max_tokens=64), 64, 4, 256).collect()
    texts = {}
    for r in sorted(out, key=lambda r: r["piece"]):
        key = r["doc_id"], r["doc_key"]
        texts[key] = texts.get(key, "") + r["text"]
        assert plain_units(r["text"]) == r["n_tokens"] <= 64
    assert sorted(((i, t) for (i, _), t in texts.items()), key=str) == sorted(rows, key=str)


def test_rows_without_doc_id_are_spread(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(3000)], "doc_id bigint, text string")
    whole = packing.token_counts(docs).selectExpr("pmod(xxhash64(doc_id, doc_key, 0L), 1024) as shard")
    assert whole.distinct().count() > 800
