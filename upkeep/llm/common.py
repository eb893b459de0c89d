"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.session import ensure_checkpoint_dir, ship_package

# Bytes of text that one numpy step works on; bounds the temporary arrays of a task.
SLICE_BYTES = 1 << 20


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: what follows neither recomputes ``df`` nor depends on
    the executors that made it.  ``drop_shared`` deletes it once nothing
    unwritten depends on it any more.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def staged(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """``result``, which reads ``tables``: whoever has written it may pass it to
    ``drop_shared``, which then deletes them."""
    result._staged = tables
    return result


def drop_shared(*tables: DataFrame) -> None:
    """Delete tables that ``shared_table`` wrote, and those that a ``staged``
    result reads (others are left alone)."""
    for table in tables:
        drop_shared(*getattr(table, "_staged", ()))
        if path := getattr(table, "_shared_path", None):
            sc = table.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def hash_sample(docs: DataFrame, n: int, key: str = "doc_id", salt: int = 0) -> DataFrame:
    """About ``n`` rows (never more than twice that), chosen by a hash of ``key``."""
    total = max(1, docs.count())
    share = min(1.0, n / total)
    pick = F.pmod(F.xxhash64(F.lit(salt), F.col(key).cast("string")), F.lit(1 << 30))
    return docs.where(pick < F.lit(int(share * (1 << 30)) + 1)).limit(2 * n)


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive rows whose sizes add up to ``limit`` at most
    (a larger row stands alone)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
