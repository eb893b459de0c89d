"""Registered archive queries, memo lineage/digests and the control-tower JSON pack."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from upkeep.operators import analytics as A
from upkeep.operators import archive as R
from upkeep.operators import packs as P
from upkeep.operators import worklists as W
from upkeep.plans import q_analytics, q_worklists  # noqa: F401  (raw SQL of pack sections)
from upkeep.plans.registry import REGISTRY, register, views
from upkeep.session import ensure_checkpoint_dir
from upkeep.sources.fixtures import AS_OF

SEP = "'\n\n" + "=" * 60 + "\n\n'"


@register("artifact_append", """
SELECT type, count(*) AS n, max(id) AS last_id FROM (
  SELECT id, type FROM reports UNION ALL SELECT 9000001, 'daily') GROUP BY type""")
def q_artifact_append(spark, sf):
    """The archive with one generated artifact appended, read back."""
    (r,) = views(spark, sf, "reports")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    rows = r.select("id", "type", "content", "created_at")
    rows.write.parquet(path)
    R.append_artifact(spark, path, {"id": 9_000_001, "type": "daily", "content": "text", "created_at": None}, rows.schema)
    return (spark.read.parquet(path).groupBy("type")
            .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id")))


@register("reports_list", """
SELECT id, type, left(content, 200) AS preview, created_at FROM reports
ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_reports_list(spark, sf):
    (r,) = views(spark, sf, "reports")
    return R.archive_list(r)


@register("reports_list_weekly", """
SELECT id, type, left(content, 200) AS preview, created_at FROM reports WHERE type = 'weekly'
ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_reports_list_weekly(spark, sf):
    (r,) = views(spark, sf, "reports")
    return R.archive_list(r, "type", "weekly")


@register("report_by_id", "SELECT id, type, content, created_at FROM reports WHERE id = 42")
def q_report_by_id(spark, sf):
    (r,) = views(spark, sf, "reports")
    return R.by_id(r, 42)


@register("reports_by_ids", """
SELECT id, type, content, created_at FROM reports
WHERE id IN (SELECT unnest(source_report_ids) FROM memos)
ORDER BY created_at DESC, id DESC""")
def q_reports_by_ids(spark, sf):
    m, r = views(spark, sf, "memos", "reports")
    cited = R.memo_source_ids(m).select(F.col("report_id").cast("bigint").alias("id"))
    return R.by_ids(r, cited)


@register("memos_list", """
SELECT id, title, source_report_ids, left(content, 200) AS preview, created_at FROM memos
ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_memos_list(spark, sf):
    (m,) = views(spark, sf, "memos")
    return R.memos_list(m)


@register("memo_sources", """
SELECT s.memo_id, cast(s.pos AS integer) AS pos, r.id AS report_id, r.type, r.created_at
FROM (SELECT id AS memo_id, unnest(source_report_ids) AS report_id,
             unnest(range(len(source_report_ids))) AS pos FROM memos) s
JOIN reports r ON r.id = s.report_id
ORDER BY s.memo_id, s.pos""")
def q_memo_sources(spark, sf):
    m, r = views(spark, sf, "memos", "reports")
    return R.memo_sources(m, r)


@register("report_digest_ids", f"""
WITH chosen AS (SELECT *, '[' || upper(type) || ' REPORT — ' || strftime(created_at, '%d %b %Y') || ']' AS label
                FROM reports WHERE list_contains([3, 14, 15, 92], id))
SELECT count(*)::integer AS n_sources,
  coalesce(array_to_string(list(label || chr(10) || content ORDER BY created_at DESC, id DESC), {SEP}), '') AS digest
FROM chosen""")
def q_report_digest_ids(spark, sf):
    (r,) = views(spark, sf, "reports")
    return R.digest_by_ids(r, [15, 3, 14, 92, 3])


@register("report_digest", f"""
SELECT s.memo_id, cast(count(*) AS integer) AS n_sources,
  string_agg('[' || upper(r.type) || ' REPORT — ' || strftime(r.created_at, '%d %b %Y') || ']' || chr(10) || r.content,
             {SEP} ORDER BY r.created_at DESC, r.id DESC) AS digest
FROM (SELECT id AS memo_id, unnest(source_report_ids) AS report_id FROM memos) s
JOIN reports r ON r.id = s.report_id
GROUP BY s.memo_id""")
def q_report_digest(spark, sf):
    m, r = views(spark, sf, "memos", "reports")
    return R.report_digest(m, r)


@register("latest_daily", """
SELECT id, type, created_at, content, left(content, 2000) AS excerpt FROM reports WHERE type = 'daily'
ORDER BY created_at DESC, id DESC LIMIT 1""")
def q_latest_daily(spark, sf):
    (r,) = views(spark, sf, "reports")
    return R.latest_of_type(r, "daily")


# -------------------------------------------------------------- control-tower pack
_PACK = [
    # (section name, registered key, Spark order, SQL order)
    ("backlog_notifications", "ct_backlog", lambda: [F.asc_nulls_last("required_end"), "id"],
     "required_end ASC NULLS LAST, id"),
    ("overdue_notifications", "ct_overdue_notif", lambda: [F.asc_nulls_last("required_end"), "id"],
     "required_end ASC NULLS LAST, id"),
    ("stagnant_wo", "ct_stagnant", lambda: [F.asc_nulls_last("basic_fin_date"), "id"],
     "basic_fin_date ASC NULLS LAST, id"),
    ("overdue_wo", "ct_overdue_wo", lambda: [F.asc_nulls_last("basic_fin_date"), "id"],
     "basic_fin_date ASC NULLS LAST, id"),
    ("pending_release_wo", "ct_pending_release", lambda: [F.asc_nulls_last("bas_start_date"), "id"],
     "bas_start_date ASC NULLS LAST, id"),
    ("wo_summary_by_type", "wo_summary_by_type", lambda: [F.asc_nulls_last("order_type")],
     "order_type ASC NULLS LAST"),
    ("notification_summary", "notification_summary", lambda: [F.desc("total"), F.asc_nulls_last("system_status")],
     "total DESC, system_status ASC NULLS LAST"),
    ("repeated_equipment", "repeated_equipment", lambda: [F.desc("notif_count"), F.asc("equipment")],
     "notif_count DESC, equipment ASC"),
]


# Sections without a limit: pack_items has them item by item as well.
_UNLIMITED = ("wo_summary_by_type", "notification_summary")


def _pack_sql():
    parts = []
    for name, key, _, order in _PACK:
        raw = REGISTRY[key].raw_sql.strip()
        parts.append(f"SELECT '{name}' AS section, count(*) AS n_rows, "
                     f"coalesce(to_json(list(t ORDER BY {order})), '[]')::varchar AS payload FROM ({raw}) t")
    return "\nUNION ALL\n".join(parts)


@register("pack_json", _pack_sql())
def q_pack_json(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    lists = W.control_tower_lists(AS_OF)
    # One row per order type or status text.
    summaries = {
        "wo_summary_by_type": (A.wo_summary_by_type(w, AS_OF), _order("wo_summary_by_type")),
        "notification_summary": (A.notification_summary(n), _order("notification_summary")),
        "repeated_equipment": (A.repeated_equipment(n), _order("repeated_equipment")),
    }
    # The five worklists come from one scan per table.
    return (P.pack_top_lists(n, lists["notifications"])
            .unionByName(P.pack_top_lists(w, lists["work_orders"]))
            .unionByName(P.pack_json(summaries)))


def _items_sql():
    parts = []
    for name, key, _, order in _PACK:
        if name in _UNLIMITED:
            raw = REGISTRY[key].raw_sql.strip()
            parts.append(f"SELECT '{name}' AS section, row_number() OVER (ORDER BY {order}) AS position, "
                         f"to_json(t)::varchar AS payload FROM ({raw}) t")
    return "\nUNION ALL\n".join(parts)


@register("pack_items", _items_sql())
def q_pack_items(spark, sf):
    """The control-tower sections without a limit, item by item."""
    n, w = views(spark, sf, "notifications", "work_orders")
    return P.pack_items({
        "wo_summary_by_type": (A.wo_summary_by_type(w, AS_OF), _order("wo_summary_by_type")),
        "notification_summary": (A.notification_summary(n), _order("notification_summary"))})


def _order(key):
    return next(order for _, k, order, _ in _PACK if k == key)()


@register("reports_local_stamp", """
SELECT id, strftime(created_at + INTERVAL 7 HOUR, '%d %b %Y %H.%M') AS stamp FROM reports""")
def q_reports_local_stamp(spark, sf):
    (r,) = views(spark, sf, "reports")
    return r.select("id", R.local_stamp(F.col("created_at")).alias("stamp"))
