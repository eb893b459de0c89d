"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names: every operator has a defined result for each."""

import public_tokenizers
import pytest

from upkeep.llm import bpe, html_text, jaccard, langid, licenses, packing, parsing, pii, quality, secret_scan

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
MODEL = langid.train([b"the cat and the dog", b"der Hund und die Katze"] * 4, ["en", "de"] * 4, epochs=1)

OPERATORS = {
    "licenses": licenses.scan_licenses,
    "language": lambda d: langid.identify(d, MODEL),
    "packing": lambda d: packing.pack(packing.token_counts(d)),
    "secrets": secret_scan.find_secrets,
    "bpe": lambda d: bpe.decode(bpe.encode(d, PATH, PATTERN), PATH, PATTERN),
    "jaccard": jaccard.join_classes,
    "parsing": parsing.compare_edits,
    "quality": quality.quality,
    "pii": pii.find_pii,
}
LONG = "one two three four five six seven eight nine ten\n" * 6000 + "x" * 150_000
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row string, part string, "
          "key int, ids string, node string, comp int, start int, base string, band string, label string, "
          "text_key string, `order` int, at int, block int, slot string, batch string, g int, found string")
ROWS = [
    (1, "the same words stand here again and again for a test"),
    (1, "the same words stand here again and again for a test"),
    (2, "the same words stand here again and again for a test"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "a row without an id, which is kept"),
    (6, LONG),
    (7, "12345 !!! \U0001F600\u0000 é"),
]


def frame(spark, rows):
    width = SCHEMA.count(",") + 1
    full = [(i, t, "en" if i else None, None if i == 2 else "s", None, "r", "p", 1, "i", "n", 2, 3, "b", "d", "l",
             "t", 4, 5, 6, "z", "y", 7, "f")[:width] for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_and_nothing_fails(spark, name):
    out = OPERATORS[name](frame(spark, ROWS)).collect()
    ids = [r["doc_id"] for r in out]
    if name == "packing":           # a long text has many pieces
        assert set(ids) == {1, 2, 3, 4, 5, 6, 7, None}
    else:
        assert sorted(ids, key=str) == sorted((i for i, _ in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_pages(spark):
    rows = [(1, "u", "<p>Hello  there &amp; you</p>", "x"), (2, None, None, "x"), (None, "v", "", "x"),
            (1, "u", "<p>Hello  there &amp; you</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = sorted(((r["page_id"], r["url"], r["text"]) for r in html_text.extract(pages).collect()), key=str)
    assert out == sorted([(1, "u", "Hello there & you"), (2, None, ""), (None, "v", ""),
                          (1, "u", "Hello there & you")], key=str)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_text_rewriting_stages_keep_columns(spark):
    docs = frame(spark, ROWS)
    given = sorted(map(str, docs.collect()))
    for out in (langid.accepted(docs, model=MODEL), quality.accepted(docs), jaccard.deduplicated(docs)):
        assert out.columns == docs.columns
        left = sorted(map(str, out.collect()))
        assert all(left.count(x) <= given.count(x) for x in left)       # rows go, none changes
    # Texts without a letter fail the language stage, short ones the rules; copies leave one row.
    assert quality.accepted(docs).count() == 0
    assert {r["doc_id"] for r in langid.accepted(docs, model=MODEL).collect()} <= {1, 2, 6, 7, None}
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert sorted(map(str, masked.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert jaccard.deduplicated(docs).where("doc_id in (1, 2)").count() == 1
    assert jaccard.deduplicated(docs).where("doc_id is null").count() == 1
