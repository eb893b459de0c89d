"""A corpus pipeline of five stages over the ``documents`` table.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet to the shared folder and rereads it for the next
stage.  All stages but the last return the columns of ``documents``; the last
returns the pieces with their (masked) texts, from which every document that
was kept can be put together again.

Defined cases: a document without a letter (null and empty ones among them)
goes in the language stage; a null doc_id or source is kept; documents that
repeat or reuse a doc_id are told apart by their texts; texts of any length are
judged whole and packed in pieces; an empty table gives an empty result; other
columns pass through to the fourth stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from upkeep.llm import jaccard, langid, packing, pii, quality
from upkeep.llm.common import drop_shared, load, shared_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the others go."""
    return langid.accepted(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the others go."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return jaccard.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with their texts, dealt into token-budget batches."""
    return packing.pack(packing.token_counts(docs, keep_text=True))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("quality", rules),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

# Training by gradient steps has no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        done = shared_table(result, f"stage-{name}")
        drop_shared(docs, result)
        docs = done
    return docs
