"""Report archive queries: lists, lookups, memo lineage and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.status import preview

PREVIEW_LEN = 200
EXCERPT_LEN = 2000
# Digest label layout and the separator between reports.
DIGEST_SEPARATOR = "\n\n" + "=" * 60 + "\n\n"
LOCAL_OFFSET = "+07:00"


def local_stamp(ts: Column, fmt: str = "dd MMM yyyy HH.mm", offset: str = LOCAL_OFFSET) -> Column:
    """A UTC wall-clock timestamp shown on the local (UTC+7) clock; plain
    interval arithmetic on the zone-free value, independent of the session zone."""
    sign = -1 if offset.startswith("-") else 1
    hours, mins = (int(x) for x in offset.lstrip("+-").split(":"))
    shift = F.make_dt_interval(F.lit(0), F.lit(sign * hours), F.lit(sign * mins))
    return F.date_format(ts.cast("timestamp_ntz") + shift, fmt)


def archive_list(df: DataFrame, type_col: str = "type", type_value: str | None = None,
                 limit: int = 100, extra: tuple[str, ...] = ()) -> DataFrame:
    """Newest first, optional type filter, 200-character preview, top-k."""
    f = df.filter(F.col(type_col) == type_value) if type_value else df
    return (f.select("id", *([type_col] if type_col else []), *extra,
                     preview(F.col("content"), PREVIEW_LEN).alias("preview"), "created_at")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(limit))


def memos_list(memos: DataFrame, limit: int = 100) -> DataFrame:
    return (memos.select("id", "title", "source_report_ids",
                         preview(F.col("content"), PREVIEW_LEN).alias("preview"), "created_at")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(limit))


def by_id(df: DataFrame, id_value) -> DataFrame:
    return df.filter(F.col("id") == F.lit(id_value))


def by_ids(df: DataFrame, ids) -> DataFrame:
    """Rows whose id is in ``ids`` (a short list, or a DataFrame with ``id``), newest first."""
    if isinstance(ids, DataFrame):
        f = df.join(ids.select("id").distinct(), "id", "left_semi")
    else:
        f = df.filter(F.col("id").isin(list(ids)))
    return f.select("id", "type", "content", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def memo_source_ids(memos: DataFrame) -> DataFrame:
    """Every (memo, position, report id) the memos cite."""
    return memos.select(F.col("id").alias("memo_id"),
                        F.posexplode("source_report_ids").alias("pos", "report_id"))


def memo_sources(memos: DataFrame, reports: DataFrame) -> DataFrame:
    """Expand each memo to the reports it cites (ids with no report drop out)."""
    r = reports.select(F.col("id").cast("bigint").alias("report_id"), "type", "created_at")
    return (memo_source_ids(memos).withColumn("report_id", F.col("report_id").cast("bigint"))
            .join(r, "report_id", "inner")
            .select("memo_id", F.col("pos").cast("int").alias("pos"), "report_id", "type", "created_at")
            .orderBy("memo_id", "pos"))


def digest_label(type_col: Column, created_at: Column) -> Column:
    """``[DAILY REPORT — 05 Jan 2024]``."""
    return F.concat(F.lit("["), F.upper(type_col), F.lit(" REPORT — "),
                    F.date_format(created_at, "dd MMM yyyy"), F.lit("]"))


def report_digest(memos: DataFrame, reports: DataFrame) -> DataFrame:
    """Per memo, the full texts of its cited reports, newest first, each
    under its label, joined by a separator line.  Groups are bounded by the
    memo's id array, never by the archive size."""
    r = reports.select(F.col("id").cast("bigint").alias("report_id"), "type", "content", "created_at")
    src = (memo_source_ids(memos).withColumn("report_id", F.col("report_id").cast("bigint"))
           .join(r, "report_id", "inner")
           .select("memo_id", F.struct(F.col("created_at").alias("ts"), F.col("report_id").alias("rid"),
                                       F.concat(digest_label(F.col("type"), F.col("created_at")),
                                                F.lit("\n"), F.col("content")).alias("piece")).alias("p")))
    g = src.groupBy("memo_id").agg(F.sort_array(F.collect_list("p"), asc=False).alias("parts"))
    return g.select("memo_id", F.size("parts").cast("int").alias("n_sources"),
                    F.array_join(F.transform("parts", lambda p: p["piece"]), DIGEST_SEPARATOR).alias("digest"))


def digest_by_ids(reports: DataFrame, ids: list[int]) -> DataFrame:
    """One row: the digest of chosen reports, newest first.  Ids without a
    report drop out, repeated ids count once; the list given bounds the text."""
    wanted = sorted(set(ids))
    r = reports.filter(F.col("id").cast("bigint").isin(wanted)) if wanted else reports.limit(0)
    piece = F.concat(digest_label(F.col("type"), F.col("created_at")), F.lit("\n"), F.col("content"))
    parts = r.agg(F.sort_array(F.collect_list(F.struct(
        F.col("created_at").alias("ts"), F.col("id").cast("bigint").alias("rid"), piece.alias("piece"))),
        asc=False).alias("parts"))
    return parts.select(F.size("parts").cast("int").alias("n_sources"),
                        F.array_join(F.transform("parts", lambda p: p["piece"]), DIGEST_SEPARATOR).alias("digest"))


def latest_of_type(reports: DataFrame, type_value: str = "daily") -> DataFrame:
    """The newest report of a type with its first 2,000 characters as excerpt."""
    return (reports.filter(F.col("type") == type_value)
            .orderBy(F.desc("created_at"), F.desc("id")).limit(1)
            .select("id", "type", "created_at", "content",
                    F.substring("content", 1, EXCERPT_LEN).alias("excerpt")))


def append_artifact(spark, table_path: str, row: dict, schema) -> None:
    """Append one generated artifact (report, memo, talking points,
    control-tower output) to its table.  The caller supplies the id (a
    natural or hash key), so no single-partition sequence is needed."""
    spark.createDataFrame([row], schema).write.mode("append").parquet(table_path)
