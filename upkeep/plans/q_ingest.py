"""Registered ingest queries over all-text exports derived from the fixtures."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from upkeep.functions.cleaners import clean_date, clean_number, clean_string
from upkeep.plans.registry import register, views
from upkeep.session import ensure_checkpoint_dir
from upkeep.sources import ingest as I
from upkeep.sources.exports import LAYOUTS, header_position
from upkeep.sources.raw_exports import RAW_LAYOUTS, raw_export
from upkeep.sources.xlsx import cells_of, workbooks

BATCH = "B-INGEST"
STAMP = dt.datetime(2001, 7, 1)
STAMP_SQL = "TIMESTAMP '2001-07-01 00:00:00'"
KIND_OF_VIEW = {"notifications": "notification", "work_orders": "work_order", "bom": "bom",
                "cost_lines": "cji3"}
SQL_TYPE = {"s": "varchar", "d": "date", "b": "boolean"}


def _key_sql(view):
    return {"notifications": "id", "work_orders": "cast(split_part(id, '-', 2) AS bigint)",
            "bom": "id", "cost_lines": "id", "asset_status": "id"}[view]


def _src_sql(view, src):
    if src == "key":
        return _key_sql(view)
    extra = {"long_text": "CASE WHEN has_long_text THEN 'X' END", "bom_category": "'M'",
             "wbs_element": "'W-' || project_definition", "cost_element": "'400000'"}
    return extra.get(src, src)


def _spoil_sql(v, k, cls):
    t = f"cast({v} AS varchar)"
    if cls == "t":
        cell = f"CASE WHEN {k} % 11 = 0 THEN '' WHEN {k} % 10 = 0 THEN '  ' || {t} || '  ' ELSE {t} END"
    elif cls == "n":
        cell = f"CASE WHEN {k} % 13 = 0 THEN 'n/a' ELSE {t} END"
    elif cls == "d":
        cell = (f"CASE WHEN {k} % 17 = 0 THEN '2024-13-40' WHEN {k} % 19 = 0 THEN '2024-5' "
                f"WHEN {k} % 23 = 0 THEN {t} || ' junk' WHEN {k} % 29 = 0 THEN '2024' "
                f"WHEN {k} % 31 = 0 THEN {t} || ' 10:30:00' ELSE {t} END")
    else:
        cell = t
    return f"CASE WHEN {k} % 101 = 0 THEN NULL ELSE {cell} END"


def raw_sql(view):
    k = _key_sql(view)
    cells = [f"{_spoil_sql(_src_sql(view, src), k, cls)} AS c{i}"
             for i, (_, src, cls) in enumerate(RAW_LAYOUTS[view])]
    n = len(cells)
    return (f"SELECT * FROM (SELECT {', '.join(cells)} FROM {view}) r "
            f"WHERE NOT ({' AND '.join(f'c{i} IS NULL' for i in range(n))})")


def _date_sql(c):
    """A day, or a day and a time of day; nothing shorter and nothing else."""
    return f"cast(coalesce(try_strptime(trim({c}), '%Y-%m-%d'), try_strptime(trim({c}), '%Y-%m-%d %H:%M:%S')) AS date)"


def _clean_sql(c, k, arg):
    if k == "s":
        return f"nullif(trim({c}), '')"
    if k == "d":
        return _date_sql(c)
    if k == "n":
        return f"try_cast(trim({c}) AS decimal(18,{arg}))"
    return f"coalesce(trim({c}) IN ('X', 'x', '1', 'True'), false)"


def typed_select(view):
    kind = KIND_OF_VIEW[view]
    headers = [h for h, _, _ in RAW_LAYOUTS[view]]
    cols = []
    for spec, name, k, arg in LAYOUTS[kind]:
        pos = header_position(headers, spec)
        typ = SQL_TYPE.get(k, f"decimal(18,{arg})")
        cols.append(f"cast(NULL AS {typ}) AS {name}" if pos is None else f"{_clean_sql(f'c{pos}', k, arg)} AS {name}")
    return f"SELECT {', '.join(cols)}, '{BATCH}' AS upload_batch, {STAMP_SQL} AS uploaded_at FROM ({raw_sql(view)}) raw"


def _ingest(view):
    @register(f"ingest_{view}",
              typed_select(view))
    def q(spark, sf):
        return I.clean_export(raw_export(spark, sf, view), BATCH, STAMP)
    return q


for _v in ("notifications", "work_orders", "bom", "cost_lines"):
    _ingest(_v)


def _dealt(rows, least):
    """Rows in partitions of ``least`` rows at least (on average) that keep all
    cores busy.  Rows are shuffled only where a partition has over twice its
    share, as a file that cannot be split does, and then by their number: keys may
    be null or repeat."""
    counts = [r["count"] for r in rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    total, cores = sum(counts), rows.sparkSession.sparkContext.defaultParallelism
    most = max(1, total // least)
    if max(counts, default=0) > 2 * max(least, total / cores):
        return rows.withColumn("_number", F.monotonically_increasing_id()).repartition(min(most, 4 * cores), "_number").drop("_number")
    return rows.coalesce(most)


BOOK_ROWS = 5000            # of a workbook
FILE_BOOKS = 16             # workbooks of a staged file, which a reader may hold at once


@register("ingest_workbooks", typed_select("work_orders"))
def q_ingest_workbooks(spark, sf):
    """The work-order export as workbooks of about 5,000 rows with typed date
    cells, read back through the workbook reader.  The workbooks are staged in
    the shared folder; their cells are not."""
    ex = raw_export(spark, sf, "work_orders")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/workbooks-{uuid.uuid4().hex}"
    books = workbooks(_dealt(ex.raw, BOOK_ROWS), ex.headers, BOOK_ROWS, "work_orders")
    books.write.option("maxRecordsPerFile", FILE_BOOKS).option("compression", "none").parquet(path)
    staged = spark.read.parquet(path)
    ex = I.workbook_export(cells_of(staged), "work_orders", cells_of(staged.limit(1)))
    return I.clean_export(ex, BATCH, STAMP).drop(I.FILE)


# Cleaners on their own, over the work-order export: text, date and number cells.
WO_TEXT = [(i, h) for i, (h, _, c) in enumerate(RAW_LAYOUTS["work_orders"]) if c == "t"]
WO_DATE = [(i, h) for i, (h, _, c) in enumerate(RAW_LAYOUTS["work_orders"]) if c == "d"]
WO_NUM = [(i, h) for i, (h, _, c) in enumerate(RAW_LAYOUTS["work_orders"]) if c == "n"]
KEY_POS = len(RAW_LAYOUTS["work_orders"]) - 1


def _cleaner_query(key, cells, spark_fn, sql_fn):
    sql = (f"SELECT c{KEY_POS} AS row_key, " + ", ".join(f"{sql_fn(f'c{i}')} AS v{i}" for i, _ in cells)
           + f" FROM ({raw_sql('work_orders')}) raw")

    @register(key, sql)
    def q(spark, sf):
        ex = raw_export(spark, sf, "work_orders")
        raw = ex.raw.na.drop(how="all")
        return raw.select(F.col(f"c{KEY_POS}").alias("row_key"),
                          *[spark_fn(F.col(f"c{i}")).alias(f"v{i}") for i, _ in cells])
    return q


_cleaner_query("clean_strings", WO_TEXT, clean_string, lambda c: f"nullif(trim({c}), '')")
_cleaner_query("clean_dates", WO_DATE, clean_date, _date_sql)
_cleaner_query("clean_numbers", WO_NUM, lambda c: clean_number(c, 2),
               lambda c: f"try_cast(trim({c}) AS decimal(18,2))")


def _violations_sql(view):
    kind = KIND_OF_VIEW[view]
    limited = [(name, arg) for _, name, k, arg in LAYOUTS[kind] if k == "s" and arg is not None]
    parts = [f"SELECT '{name}' AS column, {arg} AS max_len, "
             f"cast(coalesce(sum(CASE WHEN length({name}) > {arg} THEN 1 ELSE 0 END), 0) AS bigint) AS violations "
             f"FROM t" for name, arg in limited]
    return f"WITH t AS ({typed_select(view)})\n" + "\nUNION ALL\n".join(parts)


@register("length_violations", _violations_sql("work_orders"))
def q_length_violations(spark, sf):
    typed = I.clean_export(raw_export(spark, sf, "work_orders"), BATCH, STAMP)
    return I.length_violations(typed, "work_order")


LONG_TYPE = 7               # every so many rows of the over-long export have a type over its limit


@register("ingest_summary", "\nUNION ALL\n".join(
    [f"SELECT '{v}_export' AS file, 'ok' AS status, '{KIND_OF_VIEW[v]}' AS kind, count(*) AS rows "
     f"FROM ({raw_sql(v)}) r" for v in ("notifications", "work_orders", "bom", "cost_lines")]
    + ["SELECT 'asset_status_export', 'skip', 'unknown', cast(0 AS bigint)",
       f"SELECT 'long_export', CASE WHEN max(length(trim(c0) || ' of a length beyond')) > 10 THEN 'error' ELSE 'ok' END, "
       f"'notification', cast(0 AS bigint) FROM ({raw_sql('notifications')}) r "
       f"WHERE cast(c16 AS bigint) % {LONG_TYPE} = 0",
       "SELECT 'head_export', 'ok', 'work_order', cast(0 AS bigint)"]))
def q_ingest_summary(spark, sf):
    """Outcomes of seven exports; one has values over a limit, one only a header."""
    exports = [raw_export(spark, sf, v) for v in ("notifications", "work_orders", "bom", "cost_lines",
                                                   "asset_status")]
    notif, orders = exports[:2]
    longer = F.when(F.col("c16").cast("bigint") % LONG_TYPE == 0, F.concat("c0", F.lit(" of a length beyond"))).otherwise(F.col("c0"))
    exports += [I.Export("long_export", notif.raw.withColumn("c0", longer), notif.headers),
                I.Export("head_export", orders.raw.limit(0), orders.headers)]
    tables, outcomes = I.ingest_exports(exports, BATCH, STAMP)
    I.release(tables)
    return outcomes


@register("ingest_modes", f"""
WITH t AS ({typed_select("notifications")}), steps(step, upload_batch, part) AS (VALUES
  ('append', 'B1', 'all'), ('append', 'B2', 'all'), ('replace', 'B3', 'M1'), ('delete', 'B3', 'M1'))
SELECT step, steps.upload_batch, count(*) AS rows
FROM steps JOIN t ON part = 'all' OR notif_type = part GROUP BY ALL""")
def q_ingest_modes(spark, sf):
    """Two appends, a replace, a further append that is deleted again: the rows
    of each batch after each step, read back from the written table."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-modes-{uuid.uuid4().hex}"
    raw, path, seen = raw_export(spark, sf, "notifications"), f"{root}/notifications", []

    def look(step):
        seen.extend((step, r["upload_batch"], r["rows"]) for r in spark.read.parquet(path).groupBy("upload_batch").agg(
            F.count(F.lit(1)).alias("rows")).collect())

    for batch in ("B1", "B2"):
        I.write_tables({"notification": I.clean_export(raw, batch, STAMP)}, root, "append")
    look("append")
    some = I.clean_export(raw, "B3", STAMP).where("notif_type = 'M1'")
    I.write_tables({"notification": some}, root, "replace")
    look("replace")
    I.write_tables({"notification": I.clean_export(raw, "B4", STAMP)}, root, "append")
    I.delete_batch_files(spark, path, "B4")
    look("delete")
    return spark.createDataFrame(seen, "step string, upload_batch string, rows bigint")


@register("delete_batch", """
SELECT * FROM notifications WHERE upload_batch IS NULL OR upload_batch <> 'B1'""")
def q_delete_batch(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return I.without_batch(n, "B1")
