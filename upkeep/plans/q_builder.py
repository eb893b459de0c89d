"""Registered builder charts: one per catalog measure, plus filters, top-N,
grouped and pivoted forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from upkeep.operators import builder as B
from upkeep.plans.registry import register, views
from upkeep.sources.fixtures import AS_OF

D = "DATE '2001-06-30'"

# Facts per row, totals per dimension value, and every measure as an expression over the totals.
TOTALS = {
    "notifications": f"""
SELECT x, count(*) AS n, count(*) FILTER (ordered) AS with_wo, count(*) FILTER (late) AS overdue
FROM (SELECT {{x}} AS x, length(coalesce(order_no, '')) > 0 AS ordered, required_end < {D} AS late
      FROM notifications {{where}}) fact GROUP BY x""",
    "work_orders": f"""
SELECT x, count(*) AS n, count(*) FILTER (late AND NOT finished) AS overdue, sum(plan) AS plan, count(plan) AS plans,
       sum(act) AS act, count(act) AS acts, sum(act) FILTER (plan IS NOT NULL) - sum(plan) FILTER (act IS NOT NULL) AS over
FROM (SELECT {{x}} AS x, total_plan_cost AS plan, total_act_cost AS act, basic_fin_date < {D} AS late,
             regexp_matches(system_status, 'teco|clsd', 'i') AS finished
      FROM work_orders {{where}}) fact GROUP BY x"""}
NOTIF_SQL = {"count": "n", "count_with_wo": "with_wo", "count_no_wo": "n - with_wo", "count_overdue": "overdue",
             "pct_with_wo": "round(with_wo * 100.0::double / n, 1)"}
WO_SQL = {"count": "n", "sum_plan": "round(plan, 0)::double", "sum_actual": "round(act, 0)::double",
          "avg_plan": "round(plan::double / nullif(plans, 0), 0)", "avg_actual": "round(act::double / nullif(acts, 0), 0)",
          "cost_overrun": "round(over, 0)::double", "count_overdue": "overdue"}


def _ungrouped(key, table, x, agg_sql_map, agg, where="", top_n=20, filters=()):
    sql = (f"WITH total AS ({TOTALS[table].format(x=x, where=where)}), "
           f"valued AS (SELECT x AS {x}, {agg_sql_map[agg]} AS value FROM total) "
           f"SELECT * FROM valued ORDER BY value DESC NULLS FIRST, {x} ASC NULLS LAST LIMIT {top_n}")

    @register(key, sql)
    def q(spark, sf):
        (df,) = views(spark, sf, table)
        spec = B.ChartSpec(table=table, x_col=x, agg=agg, filters=tuple(filters), top_n=top_n)
        return B.build_chart(df, spec, AS_OF)
    return q


for _m in B.MEASURES["notifications"]:
    _ungrouped(f"builder_notif_{_m}", "notifications", "notif_type", NOTIF_SQL, _m)
for _m in B.MEASURES["work_orders"]:
    _ungrouped(f"builder_wo_{_m}", "work_orders", "order_type", WO_SQL, _m)

# Two usable filters plus three that must be skipped (empty value, unknown column, empty column).
_ungrouped("builder_filtered", "notifications", "main_workctr", NOTIF_SQL, "count",
           where="WHERE location = 'RU3' AND criticality = 'H'",
           filters=(B.ChartFilter("location", "RU3"), B.ChartFilter("criticality", "H"),
                    B.ChartFilter("notif_type", ""), B.ChartFilter("description", "x"),
                    B.ChartFilter("", "M1")))

_ungrouped("builder_topn", "work_orders", "main_workctr", WO_SQL, "sum_actual", top_n=5)

GROUPED_SQL = """
SELECT location, criticality, count(*) AS value FROM notifications GROUP BY location, criticality
ORDER BY location ASC NULLS LAST, value DESC NULLS FIRST, criticality ASC NULLS LAST"""


@register("builder_grouped", GROUPED_SQL)
def q_builder_grouped(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return B.build_chart(n, B.ChartSpec("notifications", "location", "count", "criticality"), AS_OF)


_SERIES = ["H", "I", "L", "M", "—"]


def _cell(s):
    return (f"CASE WHEN count(CASE WHEN g = '{s}' THEN 1 END) = 0 THEN 0 "
            f"ELSE max(CASE WHEN g = '{s}' THEN value END) END AS \"{s}\"")


@register("builder_pivot", f"""
SELECT location, {', '.join(_cell(s) for s in _SERIES)}
FROM (SELECT location, coalesce(criticality, '—') AS g, count(*) AS value
      FROM notifications GROUP BY location, criticality) t
GROUP BY location ORDER BY location NULLS LAST""")
def q_builder_pivot(spark, sf):
    (n,) = views(spark, sf, "notifications")
    spec = B.ChartSpec("notifications", "location", "count", "criticality")
    grouped = B.build_chart(n, spec, AS_OF)
    return B.pivot_chart(grouped, "location", "criticality", _SERIES)


@register("builder_pivot_long", """
WITH cell AS (SELECT location, coalesce(criticality, '—') AS series, count(*) AS n
              FROM notifications GROUP BY ALL),
     label AS (SELECT DISTINCT series FROM cell), place AS (SELECT DISTINCT location FROM cell)
SELECT p.location, l.series, coalesce(c.n, 0) AS value
FROM place p CROSS JOIN label l
LEFT JOIN cell c ON c.location IS NOT DISTINCT FROM p.location AND c.series = l.series""")
def q_builder_pivot_long(spark, sf):
    (n,) = views(spark, sf, "notifications")
    spec = B.ChartSpec("notifications", "location", "count", "criticality")
    return B.pivot_long(B.build_chart(n, spec, AS_OF), "location", "criticality")


@register("builder_pivot_matrix", """
WITH cell AS (
  SELECT location AS x, coalesce(criticality, '—') AS g, count(*) AS n FROM notifications GROUP BY ALL
), legend AS (SELECT DISTINCT g FROM cell), full_grid AS (
  SELECT xs.x, legend.g, coalesce(cell.n, 0) AS n FROM (SELECT DISTINCT x FROM cell) xs CROSS JOIN legend
  LEFT JOIN cell ON cell.x IS NOT DISTINCT FROM xs.x AND cell.g = legend.g)
SELECT x AS location, string_agg(g, '|' ORDER BY g) AS legend, string_agg(n::varchar, '|' ORDER BY g) AS cells
FROM full_grid GROUP BY x""")
def q_builder_pivot_matrix(spark, sf):
    """The wide matrix with the legend found in the data."""
    (n,) = views(spark, sf, "notifications")
    spec = B.ChartSpec("notifications", "location", "count", "criticality")
    wide = B.pivot_matrix(B.build_chart(n, spec, AS_OF), "location", "criticality")
    return wide.select("location", F.array_join("legend", "|").alias("legend"),
                       F.array_join(F.col("cells").cast("array<string>"), "|").alias("cells"))
