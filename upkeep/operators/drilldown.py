"""Drill-down tables behind each dashboard segment, and paging.

Each drill-down is scan/join -> predicate -> projection -> total order.  Joins
on ``order_no`` keep the fan-out (one row per matching work order), as the
segment counts do.  Paging uses ``offset/limit`` on a total order; for deep
pages ``page_after`` gives key-set paging that needs no offset scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.buckets import bucket_dates
from upkeep.functions.status import (
    as_of_date, days_between, in_month, is_blank, not_blank, preview, tests_status,
)

DESC_LEN = 80

# The columns of the drill-down tables.
N9 = ["notification", "notif_type", "system_status", "criticality", "description", "equipment",
      "location", "required_end", "order_no"]
W10 = ["order_no", "order_type", "system_status", "criticality", "description", "equipment",
       "location", "basic_fin_date", "actual_finish", "main_workctr"]


def _desc(df_col: Column) -> Column:
    return preview(df_col, DESC_LEN).alias("description")


def _proj(df: DataFrame, cols, prefix=None) -> list[Column]:
    out = []
    for c in cols:
        col = df[c] if prefix is None else prefix[c]
        out.append(_desc(col) if c == "description" else col.alias(c))
    return out


def _done(w: DataFrame, alias: str | None = None) -> Column:
    return tests_status(w, "TECO", alias) | tests_status(w, "CLSD", alias)


def _keyed(n: DataFrame, w: DataFrame, how: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notifications joined to work orders on a non-blank ``order_no``.

    Blank keys never match (the right side is filtered, so a hot blank key is
    not shuffled against anything).
    """
    wn = w.filter(not_blank("order_no")).alias("w")
    # Descriptions are cut before the join, so that only what is shown is shuffled.
    na = (n.withColumn("description", _desc(n["description"])) if "description" in n.columns else n).alias("n")
    return na.join(wn, F.col("n.order_no") == F.col("w.order_no"), how), na, wn


# ------------------------------------------------------------------ D1 funnel
def funnel_total(n: DataFrame) -> DataFrame:
    return n.select(*_proj(n, N9), "id").orderBy(F.asc_nulls_last("required_end"), "id")


def funnel_no_wo(n: DataFrame) -> DataFrame:
    f = n.filter(is_blank("order_no"))
    return f.select(*_proj(f, N9), "id").orderBy(F.asc_nulls_last("required_end"), "id")


def funnel_has_wo(n: DataFrame, w: DataFrame) -> DataFrame:
    j, _, _ = _keyed(n.filter(not_blank("order_no")), w, "inner")
    cols = [F.col(f"n.{c}") if c != "description" else _desc(F.col("n.description")) for c in N9]
    return (j.select(*[c.alias(N9[i]) if N9[i] != "description" else c for i, c in enumerate(cols)],
                     F.col("w.system_status").alias("wo_status"),
                     F.col("n.id").alias("id"), F.col("w.id").alias("wo_id"))
            .orderBy(F.asc_nulls_last("required_end"), "id", "wo_id"))


def funnel_rel(n: DataFrame, w: DataFrame) -> DataFrame:
    j, _, _ = _keyed(n, w, "inner")
    j = j.filter(tests_status(w, "REL", "w"))
    return (j.select(F.col("n.notification").alias("notification"),
                     F.col("n.notif_type").alias("notif_type"),
                     F.col("n.criticality").alias("criticality"),
                     _desc(F.col("n.description")),
                     F.col("n.equipment").alias("equipment"), F.col("n.location").alias("location"),
                     F.col("n.required_end").alias("required_end"),
                     F.col("w.order_no").alias("order_no"), F.col("w.order_type").alias("order_type"),
                     F.col("w.system_status").alias("wo_status"),
                     F.col("w.basic_fin_date").alias("basic_fin_date"),
                     F.col("w.main_workctr").alias("main_workctr"),
                     F.col("n.id").alias("id"), F.col("w.id").alias("wo_id"))
            .orderBy(F.asc_nulls_last("basic_fin_date"), "id", "wo_id"))


def funnel_done(n: DataFrame, w: DataFrame) -> DataFrame:
    j, _, _ = _keyed(n, w, "inner")
    j = j.filter(_done(w, "w"))
    return (j.select(F.col("n.notification").alias("notification"),
                     F.col("n.notif_type").alias("notif_type"),
                     F.col("n.criticality").alias("criticality"),
                     _desc(F.col("n.description")),
                     F.col("n.equipment").alias("equipment"), F.col("n.location").alias("location"),
                     F.col("w.order_no").alias("order_no"), F.col("w.order_type").alias("order_type"),
                     F.col("w.system_status").alias("wo_status"),
                     F.col("w.actual_finish").alias("actual_finish"),
                     F.col("w.main_workctr").alias("main_workctr"),
                     F.col("n.id").alias("id"), F.col("w.id").alias("wo_id"))
            .orderBy(F.desc_nulls_last("actual_finish"), "id", "wo_id"))


# ------------------------------------------------------------------ D4 lead time
def lead_time_detail(n: DataFrame, w: DataFrame, notif_type: str = "M1",
                     criticality: str = "H") -> DataFrame:
    nf = n.filter(F.col("notif_date").isNotNull() & (F.col("notif_type") == notif_type)
                  & (F.col("criticality") == criticality))
    wf = w.filter(F.col("created_on").isNotNull())
    j, _, _ = _keyed(nf, wf, "inner")
    j = j.filter(F.col("w.created_on") >= F.col("n.notif_date"))
    return (j.select(F.col("n.notification").alias("notification"),
                     F.col("n.notif_type").alias("notif_type"),
                     F.col("n.criticality").alias("criticality"),
                     _desc(F.col("n.description")),
                     F.col("n.equipment").alias("equipment"), F.col("n.location").alias("location"),
                     F.col("n.notif_date").alias("notif_date"),
                     F.col("w.order_no").alias("order_no"), F.col("w.created_on").alias("created_on"),
                     days_between(F.col("w.created_on"), F.col("n.notif_date")).alias("lead_days"),
                     F.col("n.id").alias("id"), F.col("w.id").alias("wo_id"))
            .orderBy(F.desc("lead_days"), "id", "wo_id"))


# ------------------------------------------------------------------ D5 overdue by category
def overdue_detail(n: DataFrame, w: DataFrame, notif_type: str = "M1", wo_cat: str = "no_wo",
                   as_of=None) -> DataFrame:
    """Overdue notifications of one type in one work-order category.

    The category tests differ from the dashboard aggregate on purpose: crtd
    means CRTD and not REL, rel includes TECO+REL rows; an unknown category
    falls back to no_wo.
    """
    st = F.col("w.system_status")
    cat = {
        "crtd": tests_status(w, "CRTD", "w") & ~tests_status(w, "REL", "w"),
        "rel": tests_status(w, "REL", "w"),
        "teco": _done(w, "w"),
    }
    nf = n.filter((F.col("required_end") < as_of_date(as_of)) & (F.col("notif_type") == notif_type))
    if wo_cat in cat:
        j, _, _ = _keyed(nf.filter(not_blank("order_no")), w, "left")
        j = j.filter(cat[wo_cat])
        wo_status, wo_id = F.coalesce(st, F.lit("—")), F.col("w.id")
    else:
        # No work order can match a blank key: the left join contributes nothing.
        j = nf.filter(is_blank("order_no")).alias("n")
        wo_status, wo_id = F.lit("—"), F.lit(None).cast("string")
    cols = [(_desc(F.col("n.description")) if c == "description" else F.col(f"n.{c}").alias(c))
            for c in N9]
    return (j.select(*cols, wo_status.alias("wo_status"), F.col("n.id").alias("id"),
                     wo_id.alias("wo_id"))
            .orderBy(F.asc_nulls_last("required_end"), "id", F.asc_nulls_last("wo_id")))


# ------------------------------------------------------------------ D6 bad actor
def bad_actor_detail(n: DataFrame, w: DataFrame, equipment: str) -> DataFrame:
    nf = n.filter(F.col("equipment") == equipment)
    j, _, _ = _keyed(nf, w, "left")
    cols = [(_desc(F.col("n.description")) if c == "description" else F.col(f"n.{c}").alias(c))
            for c in N9]
    return (j.select(*cols,
                     F.coalesce(F.col("w.order_type"), F.lit("—")).alias("wo_type"),
                     F.coalesce(F.col("w.system_status"), F.lit("—")).alias("wo_status"),
                     F.col("w.basic_fin_date").alias("basic_fin_date"),
                     F.col("n.id").alias("id"), F.col("w.id").alias("wo_id"))
            .orderBy(F.asc_nulls_last("required_end"), "id", F.asc_nulls_last("wo_id")))


# ------------------------------------------------------------------ D7 / D8 trend
TREND_N_COLS = ["notification", "notif_type", "system_status", "criticality", "description",
                "equipment", "location", "notif_date", "required_end", "order_no"]


def trend_notif_detail(n: DataFrame, month: str) -> DataFrame:
    f = n.filter(in_month("notif_date", month))
    return f.select(*_proj(f, TREND_N_COLS), "id").orderBy(F.desc_nulls_last("notif_date"), "id")


def trend_done_detail(w: DataFrame, month: str) -> DataFrame:
    f = w.filter(in_month("actual_finish", month) & _done(w))
    return f.select(*_proj(f, W10), "id").orderBy(F.desc_nulls_last("actual_finish"), "id")


# ------------------------------------------------------------------ D9 WO by type x status
def wo_by_type_detail(w: DataFrame, order_type: str = "PT02", status: str = "rel") -> DataFrame:
    preds = {
        "crtd": tests_status(w, "CRTD") & ~tests_status(w, "REL"),
        "rel": tests_status(w, "REL"),
        "teco": tests_status(w, "TECO"),
        "clsd": tests_status(w, "CLSD"),
    }
    pred = preds.get((status or "").lower(), preds["rel"])
    f = w.filter((F.col("order_type") == order_type) & pred)
    return (f.select(*_proj(f, W10 + ["total_plan_cost", "total_act_cost"]), "id")
            .orderBy(F.asc_nulls_last("basic_fin_date"), "id"))


# ------------------------------------------------------------------ D10 status
def notif_status_detail(n: DataFrame, status: str = "OSNO") -> DataFrame:
    f = n.filter(F.col("system_status") == status)
    return f.select(*_proj(f, TREND_N_COLS), "id").orderBy(F.asc_nulls_last("required_end"), "id")


# ------------------------------------------------------------------ D12 aging
AGING_COLS = ["order_no", "order_type", "system_status", "criticality", "description", "equipment",
              "location", "basic_fin_date"]


def aging_detail(w: DataFrame, bucket: str, as_of=None) -> DataFrame:
    days = days_between(as_of_date(as_of), F.col("basic_fin_date"))
    f = w.filter((F.col("basic_fin_date") < as_of_date(as_of)) & ~tests_status(w, "TECO")
                 & ~tests_status(w, "CLSD")
                 & bucket_dates(bucket, F.col("basic_fin_date"), as_of_date(as_of)))
    return (f.select(*_proj(f, AGING_COLS), days.alias("days_overdue"), "total_act_cost",
                     "main_workctr", "id")
            .orderBy(F.desc("days_overdue"), "id"))


# ------------------------------------------------------------------ D13 backlog
BACKLOG_COLS = ["notification", "notif_type", "system_status", "criticality", "description",
                "equipment", "location", "required_end", "main_workctr"]


def backlog_detail(n: DataFrame, workctr: str) -> DataFrame:
    f = n.filter(is_blank("order_no") & (F.col("main_workctr") == workctr))
    return f.select(*_proj(f, BACKLOG_COLS), "id").orderBy(F.asc_nulls_last("required_end"), "id")


# ------------------------------------------------------------------ D14 paging
def clamp_paging(page, per_page) -> tuple[int, int]:
    """page >= 1; per_page clamped to 10..100 (default 25)."""
    page = max(1, int(page or 1))
    per_page = min(100, max(10, int(per_page or 25)))
    return page, per_page


def page(df: DataFrame, page_no: int = 1, per_page: int = 25) -> DataFrame:
    """One page of an already totally ordered drill-down."""
    page_no, per_page = clamp_paging(page_no, per_page)
    return df.offset((page_no - 1) * per_page).limit(per_page)


def joined_page(build: Callable[[DataFrame, DataFrame], DataFrame], n: DataFrame, w: DataFrame,
                order: list[tuple[str, bool]], page_no: int = 1, per_page: int = 25) -> DataFrame:
    """One page of a drill-down that joins notifications and work orders
    (``build``), in its ``order`` (which ends with ``id`` and ``wo_id``).

    The page is found on the order's columns alone: they are all that is joined,
    and a bounded top-k keeps the rows up to the page's end.  The page's row
    numbers, ``per_page`` of them, come in as one scalar subquery, and only the
    rows they name are joined again with the columns that are shown.
    """
    page_no, per_page = clamp_paging(page_no, per_page)
    sort = [F.asc_nulls_last(c) if a else F.desc_nulls_last(c) for c, a in order]
    keys = (build(n, w).select(*[c for c, _ in order]).orderBy(*sort)
            .offset((page_no - 1) * per_page).limit(per_page))
    pair = F.concat_ws(":", F.col("id").cast("string"), F.coalesce(F.col("wo_id").cast("string"), F.lit("")))
    shown = keys.agg(F.struct(F.collect_list("id").alias("ids"), F.collect_list("wo_id").alias("wo_ids"),
                              F.collect_list(pair).alias("pairs")).alias("shown")).scalar()
    wide = build(n.filter(F.array_contains(shown["ids"], F.col("id"))),
                 w.filter(F.array_contains(shown["wo_ids"], F.col("id"))))
    return wide.filter(F.array_contains(shown["pairs"], pair)).orderBy(*sort)


def page_info(df: DataFrame, per_page: int = 25) -> DataFrame:
    """``total`` rows and ``total_pages`` (at least 1) as a one-row DataFrame."""
    _, per_page = clamp_paging(1, per_page)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.lit(per_page).alias("per_page"),
                        F.when(F.col("total") > 0, F.ceil(F.col("total") / per_page))
                         .otherwise(1).cast("bigint").alias("total_pages"))


# The total order of each drill-down, ``(column, ascending)``, NULLs last in
# either direction: what ``page_after`` needs to go on from a row.
ORDERS: dict[str, list[tuple[str, bool]]] = {
    "funnel_total": [("required_end", True), ("id", True)],
    "funnel_no_wo": [("required_end", True), ("id", True)],
    "funnel_has_wo": [("required_end", True), ("id", True), ("wo_id", True)],
    "funnel_rel": [("basic_fin_date", True), ("id", True), ("wo_id", True)],
    "funnel_done": [("actual_finish", False), ("id", True), ("wo_id", True)],
    "lead_time": [("lead_days", False), ("id", True), ("wo_id", True)],
    "overdue": [("required_end", True), ("id", True), ("wo_id", True)],
    "bad_actor": [("required_end", True), ("id", True), ("wo_id", True)],
    "trend_notif": [("notif_date", False), ("id", True)],
    "trend_done": [("actual_finish", False), ("id", True)],
    "wo_by_type": [("basic_fin_date", True), ("id", True)],
    "notif_status": [("required_end", True), ("id", True)],
    "aging": [("days_overdue", False), ("id", True)],
    "backlog": [("required_end", True), ("id", True)],
}


def page_after(df: DataFrame, order: list[tuple[str, bool]], last_key: tuple | None,
               per_page: int = 25) -> DataFrame:
    """Key-set paging: rows strictly after ``last_key`` in the ``order``
    (column, ascending; NULLs last), ``per_page`` of them.  Each page is a
    filtered top-k, so its cost does not grow with the page number.  The
    columns together must identify a row."""
    _, per_page = clamp_paging(1, per_page)
    f = df
    if last_key is not None:
        after, same = F.lit(False), F.lit(True)
        for (c, asc), v in zip(order, last_key):
            if v is None:       # only NULLs stand there, and nothing after them
                same = same & F.col(c).isNull()
                continue
            beyond = (F.col(c) > F.lit(v)) if asc else (F.col(c) < F.lit(v))
            after = after | (same & (beyond | F.col(c).isNull()))
            same = same & (F.col(c) == F.lit(v))
        f = df.filter(after)
    sort = [F.asc_nulls_last(c) if a else F.desc_nulls_last(c) for c, a in order]
    return f.orderBy(*sort).limit(per_page)


def total_pages(total: int, per_page: int) -> int:
    return math.ceil(total / per_page) if total else 1


# ------------------------------------------------------------------ dispatcher
FUNNEL_SEGMENTS = ("total_notif", "no_wo", "has_wo", "rel", "done")


def detail(n: DataFrame, w: DataFrame, source: str, params: dict | None = None, as_of=None) -> DataFrame:
    """The drill-down of one dashboard segment by name, with the same defaults
    as the dashboard links.  Unknown sources or funnel segments raise
    ``ValueError``."""
    p = params or {}
    if source == "funnel":
        seg = p.get("segment", "no_wo")
        if seg == "total_notif":
            return funnel_total(n)
        if seg == "no_wo":
            return funnel_no_wo(n)
        if seg == "has_wo":
            return funnel_has_wo(n, w)
        if seg == "rel":
            return funnel_rel(n, w)
        if seg == "done":
            return funnel_done(n, w)
        raise ValueError(f"unknown funnel segment: {seg!r}")
    if source == "leadtime":
        return lead_time_detail(n, w, p.get("notif_type", "M1"), p.get("criticality", "H"))
    if source == "overdue":
        return overdue_detail(n, w, p.get("notif_type", "M1"), p.get("wo_cat", "no_wo"), as_of)
    if source == "badactor":
        return bad_actor_detail(n, w, p.get("equipment", ""))
    if source == "trend":
        month = p.get("month", "")
        if p.get("data_type", "notif") == "notif":
            return trend_notif_detail(n, month)
        return trend_done_detail(w, month)
    if source == "wo_by_type":
        return wo_by_type_detail(w, p.get("order_type", "PT02"), p.get("status", "rel"))
    if source == "notif_status":
        return notif_status_detail(n, p.get("status", "OSNO"))
    if source == "aging":
        return aging_detail(w, p.get("bucket", ""), as_of)
    if source == "backlog_workctr":
        return backlog_detail(n, p.get("workctr", ""))
    raise ValueError(f"unknown source: {source!r}")
