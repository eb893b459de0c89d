"""Access to the supplied parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_or_empty(spark: SparkSession, name: str, schema, path: str | None = None) -> DataFrame:
    """A catalog table, else a Parquet path, else an empty DataFrame of the
    expected schema: a missing upstream table yields an empty section rather
    than failing a whole pack.  Any other error surfaces."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if path is not None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(path)
    return spark.createDataFrame([], schema)
