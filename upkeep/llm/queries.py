"""The registered queries of the training-data operators and their SQL twins.

Each query applies its operator to a whole table and derives the digest
columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm import (bpe, html_text, jaccard, langid, licenses, packing, parsing, permuterm, pii, quality,
                        rotation_codes, secret_scan, whitening)
from upkeep.llm.common import load
from upkeep.llm.oracles import ORACLES


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of such structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_start(spans: Column, kinds: list[str]) -> Column:
    """The spans by start, then by kind as listed."""
    listed = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(listed, x["kind"]).alias("n"), x["end"].alias("end"),
        x["kind"].alias("kind")))
    return F.array_sort(keyed)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (html_text.extract(load(spark, sf_dir, "pages"))
            .withColumn("n_chars", F.length("text").cast("bigint")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_blocks", F.size("found").cast("bigint").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(
            ":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        F.array_join(F.transform("found", lambda x: F.concat_ws("/", x["lacks"], x["adds"])), ",")
        .alias("differences"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(load(spark, sf_dir, "documents")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(load(spark, sf_dir, "documents"))
    kinds = secret_scan.KINDS
    return found.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in kinds[:3]],
        F.sha2(spans_text(by_start(F.col("base"), kinds)), 256).alias("base_sha256"),
        spans_text(by_start(F.concat("base", "added"), kinds)).alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.decode(bpe.encode(load(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(load(spark, sf_dir, "documents"))


def op8_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compare_edits(load(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents")).drop("source", "text_key")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(spans_text(by_start(F.col("base"), pii.KINDS)), 256).alias("base_sha256"),
        spans_text(by_start(F.concat("base", "added"), pii.KINDS)).alias("spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_codes.near_duplicates(load(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.group_variants(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_licenses": op2_licenses,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_jaccard": op7_jaccard,
    "op8_parsing": op8_parsing,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_whitening": op11_whitening,
    "op12_codes": op12_codes,
    "op13_spelling": op13_spelling,
}

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
