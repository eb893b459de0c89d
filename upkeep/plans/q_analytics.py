"""Registered fixed analytics (dashboard aggregates and control-tower summaries)."""

from __future__ import annotations

from upkeep.operators import analytics as A
from upkeep.operators import worklists as W
from upkeep.plans.registry import register, views
from upkeep.sources.fixtures import AS_OF

D = "DATE '2001-06-30'"  # AS_OF in the oracle text

# The statements below are built from these views of the fixtures: work orders
# with one boolean per status word (a missing status has none of them), and
# notifications with one for "an order number is there".
FLAGGED = """
wo AS (SELECT w.*, word.* FROM work_orders w, LATERAL (
  SELECT coalesce(contains(s, 'crtd'), false) AS crtd, coalesce(contains(s, 'rel'), false) AS rel,
         coalesce(contains(s, 'teco'), false) AS teco, coalesce(contains(s, 'clsd'), false) AS clsd
  FROM (SELECT lower(w.system_status) AS s)) word),
nt AS (SELECT *, length(coalesce(order_no, '')) > 0 AS ordered FROM notifications)"""


@register("funnel_head", f"""
WITH {FLAGGED}, tally AS (SELECT count(*) AS total, count(*) FILTER (ordered) AS has_wo FROM nt)
SELECT total, has_wo, total - has_wo AS backlog,
  if(total = 0, 0, round(100.0 * has_wo / total))::bigint AS conversion_pct
FROM tally""")
def q_funnel_head(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return A.funnel_head(n)


# Join rows are counted per order number: notifications of the number times work orders of it.
TAIL = f"""{FLAGGED},
per_key AS (SELECT order_no, count(*) AS times FROM nt WHERE ordered GROUP BY order_no),
tail AS (SELECT coalesce(sum(times) FILTER (rel), 0)::bigint AS rel,
                coalesce(sum(times) FILTER (teco OR clsd), 0)::bigint AS done
         FROM per_key JOIN wo USING (order_no))"""


@register("funnel_tail", f"WITH {TAIL} SELECT rel, done FROM tail")
def q_funnel_tail(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.funnel_tail(n, w)


@register("funnel", f"""
WITH {TAIL}, head AS (SELECT count(*) AS total, count(*) FILTER (ordered) AS has_wo FROM nt)
SELECT total, has_wo, rel, done,
  {", ".join(f"if(total = 0, 0, round(100.0 * {c} / total))::bigint AS {c}_pct" for c in ("has_wo", "rel", "done"))}
FROM head, tail""")
def q_funnel(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.funnel(n, w)


# The segments of the lead-time chart.
LEAD_SQL = """
SELECT notif_type, criticality,
  round(sum(wait * pairs) / sum(pairs))::integer AS avg_days, sum(pairs)::bigint AS cnt
FROM (SELECT notif_type, criticality, date_diff('day', notif_date, created_on) AS wait, count(*) AS pairs
      FROM notifications JOIN (SELECT order_no, created_on FROM work_orders) made USING (order_no)
      WHERE list_contains(['M1', 'M2', 'M3'], notif_type)
        AND list_contains(['H', 'M', 'L'], criticality)
      GROUP BY ALL)
WHERE wait >= 0
GROUP BY notif_type, criticality"""


@register("lead_time", LEAD_SQL)
def q_lead_time(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.lead_time(n, w)


@register("lead_time_matrix", f"""
SELECT notif_type, {", ".join(f"coalesce(any_value(avg_days) FILTER (criticality = '{c}'), 0)::integer AS {c}"
                              for c in ("H", "M", "L"))}
FROM ({LEAD_SQL}) GROUP BY notif_type""")
def q_lead_time_matrix(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.lead_time_matrix(A.lead_time(n, w))


# A work order's stage: 1 created, 2 released, 3 done; a number without one counts as created.
OVERDUE_SQL = f"""
WITH {FLAGGED},
stage AS (SELECT order_no, greatest(1, 2 * rel::int, 3 * (teco OR clsd)::int) AS step FROM wo),
late AS (SELECT notif_type, order_no, ordered FROM nt WHERE required_end < {D}),
placed AS (SELECT notif_type, if(ordered, ['crtd', 'rel', 'teco'][coalesce(step, 1)], 'no_wo') AS wo_cat
           FROM late LEFT JOIN stage USING (order_no))
SELECT notif_type, wo_cat, count(*) AS cnt FROM placed GROUP BY ALL"""


@register("overdue_by_wo_status", OVERDUE_SQL)
def q_overdue(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.overdue_by_wo_status(n, w, AS_OF)


@register("overdue_matrix", f"""
SELECT notif_type, {", ".join(f"coalesce(sum(cnt) FILTER (wo_cat = '{c}'), 0)::bigint AS {c}"
                              for c in ("no_wo", "crtd", "rel", "teco"))}
FROM ({OVERDUE_SQL}) GROUP BY notif_type""")
def q_overdue_matrix(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.overdue_matrix(A.overdue_by_wo_status(n, w, AS_OF))


def _monthly(source: str, day: str, where: str = "true") -> str:
    """Rows per calendar month of ``day`` from five months before this one."""
    return f"""
SELECT printf('%04d-%02d', year(m), month(m)) AS month, n AS cnt
FROM (SELECT date_trunc('month', {day}) AS m, count(*) AS n FROM {source} WHERE {where} GROUP BY m)
WHERE date_diff('month', m::date, {D}) <= 5"""


TREND_N_SQL = _monthly("notifications", "notif_date")
TREND_D_SQL = f"WITH {FLAGGED}" + _monthly("wo", "actual_finish", "teco OR clsd")


@register("trend_notifications", TREND_N_SQL)
def q_trend_n(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return A.trend_notifications(n, AS_OF)


@register("trend_finished", TREND_D_SQL)
def q_trend_d(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return A.trend_finished(w, AS_OF)


@register("trend_merged", f"""
SELECT month, coalesce(sum(cnt) FILTER (kind = 'notif'), 0)::bigint AS notif_cnt,
  coalesce(sum(cnt) FILTER (kind = 'done'), 0)::bigint AS done_cnt
FROM (SELECT 'notif' AS kind, * FROM ({TREND_N_SQL}) UNION ALL SELECT 'done', * FROM ({TREND_D_SQL}))
GROUP BY month""")
def q_trend_merged(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.trend_merged(A.trend_notifications(n, AS_OF), A.trend_finished(w, AS_OF))


@register("bad_actors", f"""
WITH {FLAGGED},
often AS (SELECT equipment, count(*) AS notif_cnt FROM nt WHERE length(equipment) > 0
          GROUP BY equipment HAVING notif_cnt >= 3),
stuck AS (SELECT equipment, count(*) AS stagnant_wo FROM wo WHERE rel AND actual_finish IS NULL GROUP BY equipment)
SELECT equipment, notif_cnt, coalesce(stagnant_wo, 0) AS stagnant_wo
FROM often LEFT JOIN stuck USING (equipment)
ORDER BY notif_cnt DESC, equipment LIMIT 10""")
def q_bad_actors(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.bad_actors(n, w)


STATUS_COUNTS = {"crtd": "crtd AND NOT rel", "rel": "rel", "teco": "teco", "clsd": "clsd"}


@register("wo_status_by_type", f"""
WITH {FLAGGED}
SELECT order_type, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in STATUS_COUNTS.items())}
FROM wo WHERE length(order_type) > 0 GROUP BY order_type""")
def q_wo_status_by_type(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return A.wo_status_by_type(w)


@register("wo_kpi", f"""
WITH {FLAGGED}
SELECT sum(if(length(order_type) > 0, {" + ".join(f"({c})::int" for c in STATUS_COUNTS.values())}, 0))::bigint
    AS kpi_total_wo, count(*) AS row_count
FROM wo""")
def q_wo_kpi(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return A.wo_kpi(w)


@register("wo_aging", f"""
WITH {FLAGGED},
-- Fixed values: bucket labels and their first day; a bucket ends where the next begins.
bucket(label, first_day, next_day) AS (VALUES ('1-7 hari', 1, 8), ('8-30 hari', 8, 31), ('31-90 hari', 31, 91),
  ('91-180 hari', 91, 181), ('>180 hari', 181, 1000000)),
open_wo AS (SELECT date_diff('day', basic_fin_date, {D}) AS age FROM wo
            WHERE system_status IS NOT NULL AND NOT (teco OR clsd))
SELECT label AS bucket, count(*) AS cnt
FROM open_wo JOIN bucket ON age >= first_day AND age < next_day GROUP BY label""")
def q_wo_aging(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return A.wo_aging(w, AS_OF)


@register("notification_status_top", """
WITH tally AS (SELECT system_status, count(*) AS cnt FROM notifications GROUP BY system_status
               HAVING system_status IS NOT NULL),
best AS (FROM tally ORDER BY cnt DESC, system_status LIMIT 8)
SELECT system_status, cnt, round(100.0 * cnt / (SELECT sum(cnt) FROM best))::bigint AS share_pct FROM best""")
def q_notif_status_top(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return A.notification_status_top(n)


@register("backlog_by_workcenter", f"""
WITH {FLAGGED}
SELECT main_workctr AS workctr, count(*) FILTER (NOT ordered) AS cnt FROM nt
WHERE length(main_workctr) > 0 GROUP BY workctr HAVING cnt > 0 ORDER BY cnt DESC, workctr LIMIT 10""")
def q_backlog_wc(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return A.backlog_by_workcenter(n)


@register("source_summary", """
WITH up AS (
  SELECT 'notifications' AS source, uploaded_at, NULL AS pr, NULL AS po FROM notifications
  UNION ALL SELECT 'work_orders', uploaded_at, purc_req, po_number FROM work_orders
  UNION ALL SELECT 'bom', uploaded_at, NULL, NULL FROM bom
  UNION ALL SELECT 'cost_lines', uploaded_at, NULL, NULL FROM cost_lines)
SELECT source, count(*) AS total, max(uploaded_at) AS last_upload,
  if(source = 'work_orders', count(nullif(pr, '')), NULL) AS with_pr,
  if(source = 'work_orders', count(nullif(po, '')), NULL) AS with_po
FROM up GROUP BY source""")
def q_source_summary(spark, sf):
    n, w, b, c = views(spark, sf, "notifications", "work_orders", "bom", "cost_lines")
    return A.source_summary(n, w, b, c)


@register("wo_summary_by_type", f"""
WITH {FLAGGED}
SELECT order_type, count(*) AS total,
  {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in {
      "stagnant": "rel AND actual_finish IS NULL", "teco": "teco", "closed": "clsd",
      "overdue": f"date_diff('day', basic_fin_date, {D}) > 0 AND system_status IS NOT NULL AND NOT (teco OR clsd)",
  }.items())}
FROM wo GROUP BY order_type""")
def q_wo_summary(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return A.wo_summary_by_type(w, AS_OF)


@register("notification_summary", f"""
WITH {FLAGGED}
SELECT system_status, count(*) AS total, count(*) FILTER (NOT ordered) AS no_wo FROM nt GROUP BY system_status""")
def q_notif_summary(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return A.notification_summary(n)


@register("repeated_equipment", """
WITH seen AS (SELECT equipment, system_status, count(*) AS n, max(required_end) AS last FROM notifications
              WHERE length(equipment) > 0 GROUP BY ALL)
SELECT equipment, sum(n)::bigint AS notif_count, string_agg(system_status, ', ' ORDER BY system_status) AS statuses,
  max(last) AS latest_req_end
FROM seen GROUP BY equipment HAVING sum(n) > 1 ORDER BY notif_count DESC, equipment LIMIT 15""")
def q_repeated_equipment(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return A.repeated_equipment(n)


@register("filter_values", """
SELECT unnest(list_sort(list(DISTINCT main_workctr) FILTER (length(main_workctr) > 0))[:200]) AS value
FROM notifications""")
def q_filter_values(spark, sf):
    from upkeep.operators.builder import filter_values
    (n,) = views(spark, sf, "notifications")
    return filter_values(n, "notifications", "main_workctr")


@register("pack_has_data", f"""
WITH {FLAGGED},
-- Fixed values: the sizes at which the three worklists end.
found AS (SELECT least(50, (SELECT count(*) FROM nt WHERE NOT ordered AND contains(lower(system_status), 'osno'))) AS backlog,
                 least(50, count(*) FILTER (rel AND actual_finish IS NULL)) AS stagnant,
                 least(30, count(*) FILTER (basic_fin_date < {D} AND system_status IS NOT NULL AND NOT (teco OR clsd)))
                   AS overdue_wo
          FROM wo)
SELECT *, backlog + stagnant + overdue_wo AS total, backlog + stagnant + overdue_wo > 0 AS has_data FROM found""")
def q_pack_has_data(spark, sf):
    n, w = views(spark, sf, "notifications", "work_orders")
    return A.pack_has_data(W.backlog(n), W.stagnant(w), W.overdue_orders(w, AS_OF))


@register("status_token_counts", r"""
SELECT lower(string_split_regex(trim(system_status), '\s+')[1]) AS token, count(*) AS cnt
FROM work_orders GROUP BY 1""")
def q_status_tokens(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return A.status_token_counts(w)
