"""Control-tower worklists: filter -> project -> total order -> top-k.

Every worklist is a bounded top-k (``TakeOrderedAndProject``): each task
keeps its own k best rows, so no task ever holds more than k rows per
partition regardless of input size.  The row key ends every ordering so the
cut is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.functions.status import as_of_date, has_status, is_blank, lacks_status, tests_status

BACKLOG_COLS = ["notif_type", "notification", "system_status", "req_start", "required_end",
                "main_workctr", "description", "equipment", "functional_loc", "criticality", "location"]
OVERDUE_NOTIF_COLS = ["notif_type", "notification", "system_status", "req_start", "required_end",
                      "description", "equipment", "criticality", "location"]
STAGNANT_COLS = ["order_no", "order_type", "system_status", "bas_start_date", "basic_fin_date",
                 "description", "equipment", "functional_loc", "criticality", "location",
                 "main_workctr", "actual_release", "actual_finish"]
OVERDUE_WO_COLS = ["order_no", "order_type", "system_status", "basic_fin_date", "description",
                   "equipment", "criticality", "location", "main_workctr"]
PENDING_COLS = ["order_no", "order_type", "system_status", "bas_start_date", "basic_fin_date",
                "description", "equipment", "criticality", "location", "main_workctr"]
TECO_NO_FINISH_COLS = ["order_no", "order_type", "system_status", "basic_fin_date",
                       "actual_finish", "equipment", "main_workctr"]


def _top(df: DataFrame, cols, order, limit):
    out = df.orderBy(*order, F.asc("id")).select("id", *cols)
    return out.limit(limit) if limit is not None else out


def backlog(n: DataFrame, limit: int | None = 50) -> DataFrame:
    """Notifications without an order and status OSNO, earliest required end first."""
    f = n.filter(is_blank("order_no") & tests_status(n, "OSNO"))
    return _top(f, BACKLOG_COLS, [F.asc_nulls_last("required_end")], limit)


def overdue_notifications(n: DataFrame, as_of=None, limit: int | None = 30) -> DataFrame:
    f = n.filter(is_blank("order_no") & (F.col("required_end") < as_of_date(as_of)))
    return _top(f, OVERDUE_NOTIF_COLS, [F.asc_nulls_last("required_end")], limit)


def stagnant(w: DataFrame, limit: int | None = 50) -> DataFrame:
    """Released orders without actual finish."""
    f = w.filter(tests_status(w, "REL") & F.col("actual_finish").isNull())
    return _top(f, STAGNANT_COLS, [F.asc_nulls_last("basic_fin_date")], limit)


def overdue_orders(w: DataFrame, as_of=None, limit: int | None = 30) -> DataFrame:
    f = w.filter((F.col("basic_fin_date") < as_of_date(as_of))
                 & ~tests_status(w, "TECO") & ~tests_status(w, "CLSD"))
    return _top(f, OVERDUE_WO_COLS, [F.asc_nulls_last("basic_fin_date")], limit)


def pending_release(w: DataFrame, limit: int | None = 20) -> DataFrame:
    f = w.filter(tests_status(w, "CRTD") & ~tests_status(w, "REL"))
    return _top(f, PENDING_COLS, [F.asc_nulls_last("bas_start_date")], limit)


def teco_without_finish(w: DataFrame, limit: int | None = None) -> DataFrame:
    """Data-consistency flag: technically completed but no actual finish date."""
    f = w.filter(tests_status(w, "TECO") & F.col("actual_finish").isNull())
    return _top(f, TECO_NO_FINISH_COLS, [F.asc_nulls_last("basic_fin_date")], limit)


# ------------------------------------------------------------------ fused top-k lists
@dataclass(frozen=True)
class TopList:
    """One worklist: a predicate, an ascending NULLS LAST sort column (then
    the row id), a row limit and the columns it shows."""
    predicate: object        # callable () -> Column
    order_col: str
    limit: int
    columns: tuple[str, ...]


def control_tower_lists(as_of=None) -> dict[str, dict[str, TopList]]:
    """The control-tower worklists grouped by the table they read."""
    st = F.col("system_status")
    return {
        "notifications": {
            "backlog_notifications": TopList(
                lambda: is_blank("order_no") & has_status(st, "OSNO"), "required_end", 50, tuple(BACKLOG_COLS)),
            "overdue_notifications": TopList(
                lambda: is_blank("order_no") & (F.col("required_end") < as_of_date(as_of)), "required_end", 30,
                tuple(OVERDUE_NOTIF_COLS)),
        },
        "work_orders": {
            "stagnant_wo": TopList(
                lambda: has_status(st, "REL") & F.col("actual_finish").isNull(), "basic_fin_date", 50,
                tuple(STAGNANT_COLS)),
            "overdue_wo": TopList(
                lambda: (F.col("basic_fin_date") < as_of_date(as_of)) & lacks_status(st, "TECO")
                & lacks_status(st, "CLSD"), "basic_fin_date", 30, tuple(OVERDUE_WO_COLS)),
            "pending_release_wo": TopList(
                lambda: has_status(st, "CRTD") & lacks_status(st, "REL"), "bas_start_date", 20,
                tuple(PENDING_COLS)),
        },
    }


def fused_top_lists(df: DataFrame, lists: dict[str, TopList], row: callable) -> DataFrame:
    """Several top-k worklists of one table, ranked together.

    Each row is tagged with every list whose predicate it meets, and only
    (list, sort key, id) is ranked: ``row_number() <= k`` is planned as a
    per-task group limit before the shuffle, so what is sorted is narrow and
    no task holds more than k rows of a list.  The wide columns are then
    fetched for the winners alone, at most the sum of the limits, which are
    broadcast on that bound.  Returns ``(_list, _rn, <row(spec)>)`` where
    ``row(spec)`` renders a row of that list (e.g. as JSON text).
    """
    names = list(lists)

    def by_list(value: callable) -> Column:
        out = None
        for n in names:
            hit = F.col("_list") == n
            out = F.when(hit, value(lists[n])) if out is None else out.when(hit, value(lists[n]))
        return out

    tags = F.array_compact(F.array(*[F.when(lists[n].predicate(), F.struct(
        F.lit(n).alias("_list"), F.col(lists[n].order_col).alias("_key"))) for n in names]))
    top = max(t.limit for t in lists.values())
    winners = (df.select("id", F.inline(tags))
               .withColumn("_rn", F.row_number().over(
                   Window.partitionBy("_list").orderBy(F.asc_nulls_last("_key"), F.asc("id"))))
               .filter(F.col("_rn") <= top)
               .filter(F.col("_rn") <= by_list(lambda t: F.lit(t.limit)))
               .select(F.col("id").alias("_id"), "_list", "_rn"))
    ranked = df.join(F.broadcast(winners), df["id"] == winners["_id"])
    return ranked.select("_list", "_rn", by_list(row).alias("_row"))
