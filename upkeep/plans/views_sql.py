"""Fixture views as SQL text for the independent oracle engine (DuckDB).

Same derivation as ``upkeep.sources.fixtures``; an oracle query references
view names and ``with_views`` prepends the needed ``WITH`` clauses.
"""

from __future__ import annotations

import re

from upkeep.sources.fixtures import MONITORING

VIEW_SQL = {
    "notifications": """
SELECT o_orderkey AS id,
  'M' || cast(o_orderkey % 4 + 1 AS varchar) AS notif_type,
  cast(o_orderdate AS date) AS notif_date,
  cast(10000000 + o_orderkey AS varchar) AS notification,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'OSNO'
       WHEN o_orderstatus = 'P' THEN 'NOPR OSTS' ELSE 'NOCO' END AS system_status,
  cast(o_orderdate AS date) AS req_start,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL
       ELSE cast(o_orderdate AS date) + cast(o_orderkey % 120 AS int) END AS required_end,
  CASE WHEN o_custkey % 19 = 0 THEN '' ELSE 'WC' || cast(o_custkey % 17 AS varchar) END AS main_workctr,
  'PG' || cast(o_custkey % 5 AS varchar) AS planner_group,
  'request ' || cast(o_orderkey AS varchar) || ' ' || repeat('x', cast(o_orderkey % 100 AS int)) AS description,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN ''
       ELSE cast(o_orderkey AS varchar) END AS order_no,
  'RU' || cast(o_custkey % 7 AS varchar) AS location,
  'FL' || cast(o_custkey % 50 AS varchar) AS functional_loc,
  'MP' || cast(o_custkey % 3 AS varchar) AS maint_plant,
  o_orderkey % 6 = 0 AS has_long_text,
  CASE WHEN o_custkey % 23 = 0 THEN '' ELSE 'EQ' || cast(o_custkey AS varchar) END AS equipment,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'H' WHEN '2' THEN 'I' WHEN '3' THEN 'M'
       WHEN '5' THEN 'L' END AS criticality,
  'B' || cast(o_orderkey % 3 AS varchar) AS upload_batch,
  o_orderdate AS uploaded_at
FROM orders""",
    "work_orders": """
SELECT cast(l_orderkey AS varchar) || '-' || cast(l_partkey AS varchar) || '-' ||
       cast(l_suppkey AS varchar) || '-' || cast(l_linenumber AS varchar) AS id,
  'P' || cast(l_suppkey % 4 AS varchar) AS plant,
  cast(l_shipdate AS date) AS created_on,
  cast(l_shipdate AS date) + cast(l_linenumber AS int) AS bas_start_date,
  CASE WHEN l_partkey % 29 = 0 THEN NULL
       ELSE cast(l_shipdate AS date) + cast(l_partkey % 250 AS int) END AS basic_fin_date,
  cast(l_orderkey AS varchar) AS order_no,
  'job ' || cast(l_partkey AS varchar) || ' ' || repeat('y', cast(l_partkey % 100 AS int)) AS description,
  'RU' || cast(l_suppkey % 7 AS varchar) AS location,
  'FL' || cast(l_partkey % 50 AS varchar) AS functional_loc,
  'EQ' || cast(l_partkey % 1500 AS varchar) AS equipment,
  CASE l_linenumber % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'M' WHEN 2 THEN 'L' END AS criticality,
  CASE WHEN l_partkey % 37 = 0 THEN NULL
       WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'CRTD MANC'
       WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'REL PRC'
       WHEN l_linestatus = 'O' THEN 'CRTD REL'
       WHEN l_returnflag = 'A' THEN 'TECO REL'
       WHEN l_returnflag = 'N' THEN 'CLSD' ELSE 'teco' END AS system_status,
  'PG' || cast(l_suppkey % 5 AS varchar) AS planner_group,
  cast(l_extendedprice AS decimal(18,2)) AS total_plan_cost,
  CASE WHEN l_partkey % 11 = 0 THEN NULL
       ELSE cast(cast(l_extendedprice AS decimal(18,2)) + cast(l_partkey % 200 - 100 AS decimal(18,2)) AS decimal(18,2)) END AS total_act_cost,
  CASE WHEN l_partkey % 13 = 0 THEN '' ELSE 'WC' || cast(l_suppkey % 17 AS varchar) END AS main_workctr,
  CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN '' ELSE 'PO' || cast(l_partkey AS varchar) END AS po_number,
  CASE WHEN l_linestatus = 'F' AND l_partkey % 7 <> 0
       THEN cast(l_shipdate AS date) + cast(l_partkey % 60 AS int) END AS actual_finish,
  CASE WHEN l_partkey % 4 <> 0 THEN cast(l_shipdate AS date) + cast(l_partkey % 20 AS int) END AS actual_release,
  CASE WHEN l_partkey % 31 = 0 THEN NULL
       ELSE CASE l_linenumber % 4 WHEN 0 THEN 'PT02' WHEN 1 THEN 'PT03' WHEN 2 THEN 'PT05' ELSE 'PT08' END END AS order_type,
  cast(l_linenumber % 3 + 1 AS varchar) AS priority,
  CASE WHEN l_suppkey % 2 = 0 THEN 'PR' || cast(l_suppkey AS varchar) END AS purc_req,
  'B' || cast(l_orderkey % 3 AS varchar) AS upload_batch,
  l_shipdate AS uploaded_at
FROM lineitem""",
    "bom": """
SELECT p_partkey AS id, 'EQ' || cast(p_partkey % 300 AS varchar) AS equipment, p_name AS equipment_desc,
  'MAT' || cast(p_partkey AS varchar) AS component, p_type AS component_desc,
  cast(p_size AS decimal(18,3)) AS quantity, timestamp '2001-06-01 00:00:00' AS uploaded_at
FROM part""",
    "cost_lines": """
SELECT l_orderkey AS id, 'PRJ' || cast(l_suppkey % 20 AS varchar) AS project_definition,
  cast(l_shipdate AS date) AS posting_date, cast(l_orderkey AS varchar) AS order_no,
  cast(l_extendedprice AS decimal(18,2)) AS val_in_rep_cur, l_shipdate AS uploaded_at
FROM lineitem""",
    "reports": """
SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS type,
  text AS content, cast(date '2024-01-01' + cast(doc_id % 200 AS int) AS timestamp) AS created_at
FROM documents""",
    "memos": """
SELECT doc_id AS id, 'Memo ' || cast(doc_id AS varchar) AS title,
  [cast(doc_id AS int), cast(doc_id + 7 AS int), cast(doc_id + 13 AS int)] AS source_report_ids,
  text AS content, cast(date '2024-03-01' + cast(doc_id % 97 AS int) AS timestamp) AS created_at
FROM documents""",
    "asset_status": """
SELECT event_id AS id, cast(ts AS date) AS period, 'RU' || cast(user_id % 7 AS varchar) AS ru,
  'TAG' || cast(user_id AS varchar) AS tag, event_type AS kind,
  CASE event_id % 9 WHEN 0 THEN 'Open' WHEN 1 THEN 'closed' WHEN 2 THEN 'DONE' WHEN 3 THEN NULL WHEN 4 THEN 'normal'
       WHEN 5 THEN 'OK' WHEN 6 THEN 'Standby' WHEN 7 THEN 'Aktif' ELSE 'valid' END AS status_a,
  CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'expired' WHEN 2 THEN NULL ELSE 'ACTIVE' END AS status_b,
  CASE event_id % 6 WHEN 0 THEN 'Red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'orange' WHEN 3 THEN 'green' WHEN 4 THEN NULL ELSE 'Merah' END AS colour,
  CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 4 = 1 THEN NULL ELSE 'issue ' || cast(event_id AS varchar) END AS issue,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS actual,
  cast(event_id % 100 AS double) AS target,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE '2024-01-15' END AS removed_on
FROM events""",
}

for _name, _cols in MONITORING.items():
    VIEW_SQL[_name] = "SELECT " + ", ".join(f"{src} AS {dst}" for dst, src in _cols) + " FROM asset_status"

# Dependency order for the WITH list.
_ORDER = ["notifications", "work_orders", "bom", "cost_lines", "reports", "memos", "asset_status",
          *MONITORING.keys()]


def _refs(sql: str) -> set[str]:
    return {v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it (transitively) references."""
    need = _refs(sql)
    frontier = set(need)
    while frontier:
        more = set()
        for v in frontier:
            more |= _refs(VIEW_SQL[v]) - need
        need |= more
        frontier = more
    ctes = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in _ORDER if v in need]
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
