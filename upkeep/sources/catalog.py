"""Catalog tables: bucketed by the join key, versioned behind a view, snapshots
by period, and many uploads in few files.

* ``write_bucketed`` writes a table in buckets of one key.  Aggregates and joins
  on that key then need no exchange.
* ``replace_table`` writes a new version as a table of its own and points the
  view of the name at it when it is complete.  A reader has the old version or
  the new one, whatever happens in between; ``vacuum`` drops old ones later.
* ``write_snapshots`` partitions a monitoring table by its period, so that the
  latest period is found without reading a row and read without the others.
* ``compact_batches`` gathers the partitions of many uploads into few files by
  ranges of the batch name; deleting a batch rewrites its range alone.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "__v"
BATCH = "upload_batch"
RANGE = "batch_range"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


# ------------------------------------------------------------------ buckets
def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "order_no", location: str | None = None) -> DataFrame:
    """Write ``df`` as catalog table ``name`` in ``buckets`` buckets of ``key``,
    sorted by it inside; returns the table.

    The rows are dealt as the buckets are, so every bucket is one file.  Tables
    that are joined take the same number of buckets.  A hot key is one bucket's
    and one task's; operators here aggregate before they join, so such a task
    makes one row of it.
    """
    spark = df.sparkSession
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(_quoted(name))
    return spark.table(_quoted(name))


# ------------------------------------------------------------------ versions
def versions(spark: SparkSession, name: str) -> list[str]:
    """The version tables of ``name``, oldest first."""
    base = name.split(".")[-1]
    space = name.rpartition(".")[0] or spark.catalog.currentDatabase()
    return sorted(t.name for t in spark.catalog.listTables(space) if re.fullmatch(re.escape(base.lower()) + VERSION + r"[0-9]{20}_[0-9a-f]{8}", t.name))


def replace_table(spark: SparkSession, df: DataFrame, name: str, buckets: int = 0, key: str = "order_no",
                  folder: str | None = None) -> str:
    """Replace what ``name`` stands for by ``df``; returns the version table.

    The version is written whole before the view is pointed at it in one catalog
    step.  If writing fails, or the driver is lost, the view stands as it was.
    """
    version = f"{name.lower()}{VERSION}{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:8]}"
    location = f"{folder.rstrip('/')}/{version.split('.')[-1]}" if folder else None
    if buckets:
        write_bucketed(df, version, buckets, key, location)
    else:
        (df.write.option("path", location) if location else df.write).saveAsTable(_quoted(version))
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} AS SELECT * FROM {_quoted(version)}")
    return version


def vacuum(spark: SparkSession, name: str, keep: int = 1) -> list[str]:
    """Drop all but the newest ``keep`` versions (those that running readers may
    still use are to be kept); returns what was dropped."""
    space = name.rpartition(".")[0]
    old = versions(spark, name)[:-keep] if keep else versions(spark, name)
    for version in old:
        table = _quoted(f"{space}.{version}" if space else version)
        location = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first()
        spark.sql(f"DROP TABLE {table}")
        if location:
            place, fs = _fs(spark, location["data_type"])
            fs.delete(place, True)
    return old


# ------------------------------------------------------------------ snapshots
def write_snapshots(df: DataFrame, path: str, period: str) -> None:
    """Write the periods that ``df`` holds, each as a partition; a period that is
    written again is replaced, the others stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path))


# ------------------------------------------------------------------ batches
def compacted_path(path: str) -> str:
    return f"{path.rstrip('/')}__compacted"


def _folders(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the partition folders of ``column`` below ``path``, as written."""
    place, fs = _fs(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(column + "="))


def _schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of a batch table, the batch as text (a folder named 0012 is no number)."""
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name not in (BATCH, RANGE)]
    return T.StructType([*fields, T.StructField(BATCH, T.StringType())])


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a batch table, compacted or not."""
    parts = []
    if _folders(spark, path, BATCH):
        parts.append(spark.read.schema(_schema(spark, path)).parquet(path))
    packed = compacted_path(path)
    if _folders(spark, packed, RANGE):
        parts.append(spark.read.schema(_schema(spark, packed)).parquet(packed).drop(RANGE))
    if not parts:
        raise ValueError(f"no batches at {path}")
    return reduce(DataFrame.unionByName, parts)


def _range_name(batches: list[str]) -> str:
    """First and last batch of a range and a mark of its own."""
    return f"{quote(batches[0], safe='')},{quote(batches[-1], safe='')},{uuid.uuid4().hex[:8]}"


def compact_batches(spark: SparkSession, path: str, per_range: int = 100) -> int:
    """Gather the batch partitions of a table by ranges of ``per_range`` batch
    names into files of the advisory size, batch column inside; returns the
    number of ranges.  A range is written beside the table and its partitions
    are deleted only then; one that failed is left as it was."""
    folders = sorted(_folders(spark, path, BATCH), key=unquote)
    done = 0
    for lo in range(0, len(folders), per_range):
        chunk = folders[lo:lo + per_range]
        schema = _schema(spark, f"{path}/{BATCH}={chunk[0]}")
        rows = (spark.read.schema(schema).option("basePath", path)
                .parquet(*[f"{path}/{BATCH}={name}" for name in chunk]))
        _write_range(spark, rows, path, [unquote(c) for c in chunk])
        place, fs = _fs(spark, path)
        for name in chunk:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, f"{BATCH}={name}"), True)
        done += 1
    return done


def _write_range(spark: SparkSession, rows: DataFrame, path: str, batches: list[str]) -> None:
    """Write a range under a hidden name and show it by one rename."""
    name, packed = _range_name(batches), compacted_path(path)
    hidden, shown = f"{packed}/_{RANGE}-{uuid.uuid4().hex}", f"{packed}/{RANGE}={quote(name, safe=',')}"
    rows.sortWithinPartitions(BATCH).hint("rebalance").write.parquet(hidden)
    source, fs = _fs(spark, hidden)
    if not fs.rename(source, _fs(spark, shown)[0]):
        raise OSError(f"{hidden} could not be renamed")


def delete_batch(spark: SparkSession, path: str, batch: str) -> int:
    """Delete one batch; returns the number of folders that were touched: its
    own partition, or the ranges whose bounds enclose its name."""
    touched = 0
    for name in _folders(spark, path, BATCH):
        if unquote(name) == batch:
            place, fs = _fs(spark, f"{path}/{BATCH}={name}")
            fs.delete(place, True)
            touched += 1
    packed = compacted_path(path)
    for name in _folders(spark, packed, RANGE):
        first, last, _ = unquote(name).split(",")
        if not unquote(first) <= batch <= unquote(last):
            continue
        folder = f"{packed}/{RANGE}={name}"
        rows = spark.read.schema(_schema(spark, folder)).parquet(folder)
        left = rows.filter(F.col(BATCH) != batch)
        if rows.filter(F.col(BATCH) == batch).isEmpty():
            continue
        if not left.isEmpty():
            _write_range(spark, left, path, [unquote(first), unquote(last)])
        place, fs = _fs(spark, folder)
        fs.delete(place, True)
        touched += 1
    return touched
