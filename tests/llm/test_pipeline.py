import re

from pyspark.sql import functions as F

import corpus_pipeline
from upkeep.llm import jaccard, queries

from ..conftest import SF_SMALL


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF_SMALL).cache())
    source, language, rules, unique, private, packed = seen
    assert all(d.columns == columns for d in seen[:-1])
    # Documents with letters in a learned language stay.
    assert language.count() == source.where(F.col("text").rlike(r"\p{L}")).count()
    texts = {r["doc_id"]: r["text"] for r in rules.collect()}
    for i, t in texts.items():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 20, i
    classes = {r["doc_id"]: r["class_id"] for r in jaccard.join_classes(rules).collect()}
    assert {r["doc_id"] for r in unique.collect()} == set(classes.values())
    assert private.count() == unique.count()
    masked = {r["doc_id"]: r for r in private.collect()}
    assert not any(re.search(r"[a-z0-9]@[a-z0-9]+\.", r["text"]) for r in masked.values())
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    again = {}
    for r in sorted(packed.collect(), key=lambda r: r["piece"]):
        again[r["doc_id"]] = again.get(r["doc_id"], "") + r["text"]
    assert again == {i: r["text"] for i, r in masked.items()}


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.count() > 0 and "batch" in out.columns


def test_queries_have_the_contract_columns(spark):
    want = {
        "op1_html": ["page_id", "url", "text", "n_chars"],
        "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op6_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op8_parsing": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op9_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }
    for name, columns in want.items():
        out = queries.queries()[name](spark, SF_SMALL)
        assert set(columns) <= set(out.columns), name
        table = "pages" if name == "op1_html" else "documents"
        assert out.count() == spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count(), name


def test_oracles(spark):
    """The SQL twins agree on the small tables."""
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    for name, sql in queries.oracle_sql().items():
        out = queries.queries()[name](spark, SF_SMALL)
        got = sorted((tuple(r) for r in out.collect()), key=str)
        assert got == sorted(con.sql(f"SELECT {', '.join(out.columns)} FROM ({sql})").fetchall(), key=str), name
