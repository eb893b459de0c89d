"""Fixed analytics over notifications (``n``) and work orders (``w``).

Join strategy.  ``order_no`` is not unique on either side and one key may
carry a large share of all rows, so queries that aggregate over join rows
first aggregate each side per join key (partial aggregation collapses a hot
key map-side), then join one row per key and weight by the counts.  The
result equals the row-level join; its size is bounded by the number of keys
instead of the product of duplicates.  A blank order number is a missing one,
here and in the drill-downs: it matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.functions.buckets import aging_bucket
from upkeep.functions.status import (
    as_of_date, days_between, is_blank, month_floor, month_label, not_blank, tests_status,
)

def _one() -> Column:
    return F.lit(1)


def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT (NULL cond -> 0)."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _done(w: DataFrame) -> Column:
    return tests_status(w, "TECO") | tests_status(w, "CLSD")


# ---------------------------------------------------------------- A1 / A2 funnel
def funnel_head(n: DataFrame) -> DataFrame:
    """total notifications, with a (non-blank) order, backlog and conversion %."""
    agg = n.agg(F.count(_one()).alias("total"),
                F.coalesce(count_if(not_blank("order_no")), F.lit(0).cast("bigint")).alias("has_wo"))
    return agg.select(
        "total", "has_wo",
        (F.col("total") - F.col("has_wo")).alias("backlog"),
        F.when(F.col("total") > 0, F.round(F.col("has_wo") * 100.0 / F.col("total")).cast("bigint"))
         .otherwise(F.lit(0).cast("bigint")).alias("conversion_pct"),
    )


def funnel_tail(n: DataFrame, w: DataFrame) -> DataFrame:
    """REL and TECO/CLSD counted over join rows (fan-out kept, overlap allowed)."""
    nk = (n.filter(not_blank("order_no")).groupBy("order_no")
          .agg(F.count(_one()).alias("n_cnt")))
    wk = (w.filter(not_blank("order_no") & (tests_status(w, "REL") | _done(w))).groupBy("order_no")
          .agg(count_if(tests_status(w, "REL")).alias("w_rel"),
               count_if(_done(w)).alias("w_done")))
    j = nk.join(wk, "order_no", "inner")
    z = F.lit(0).cast("bigint")
    return j.agg(F.coalesce(F.sum(F.col("n_cnt") * F.col("w_rel")), z).cast("bigint").alias("rel"),
                 F.coalesce(F.sum(F.col("n_cnt") * F.col("w_done")), z).cast("bigint").alias("done"))


def funnel(n: DataFrame, w: DataFrame) -> DataFrame:
    """The four funnel stages with each stage's share of all notifications
    (rounded percent, 0 when there are none).  The join-row counts come in as
    scalar subqueries, so the one-row results are combined without a join."""
    tail = funnel_tail(n, w)
    head = funnel_head(n)
    total = F.col("total")

    def pct(c: Column) -> Column:
        return F.when(total > 0, F.round(c * 100.0 / total)).otherwise(F.lit(0.0)).cast("bigint")

    return (head.select("total", "has_wo", tail.select("rel").scalar().alias("rel"),
                        tail.select("done").scalar().alias("done"))
            .select("total", "has_wo", "rel", "done", pct(F.col("has_wo")).alias("has_wo_pct"),
                    pct(F.col("rel")).alias("rel_pct"), pct(F.col("done")).alias("done_pct")))


# ---------------------------------------------------------------- A3 lead time
# The segments of the lead-time chart.
LEAD_CRITICALITIES = ["H", "M", "L"]
LEAD_TYPES = ["M1", "M2", "M3"]


def lead_time(n: DataFrame, w: DataFrame) -> DataFrame:
    """Average days from notification to work-order creation per type x criticality.

    Both sides are aggregated per (key, date) and laid on one time line per
    key.  Going back from the newest date, running sums give every
    notification date the number of work orders created on or after it and
    the sum of their day numbers, so a key costs its distinct dates and no
    pair of dates is built.
    """
    day = F.lit(0).cast("bigint")
    side = {"n": (n.filter(F.col("notif_date").isNotNull() & not_blank("order_no")
                           & F.col("criticality").isin(LEAD_CRITICALITIES) & F.col("notif_type").isin(LEAD_TYPES))
                  .groupBy("order_no", F.col("notif_date").alias("date"), "notif_type", "criticality")
                  .agg(F.count(_one()).alias("n_cnt"))
                  .select("order_no", "date", F.lit(1).alias("side"), "notif_type", "criticality", "n_cnt",
                          day.alias("w_cnt"))),
            "w": (w.filter(F.col("created_on").isNotNull() & not_blank("order_no"))
                  .groupBy("order_no", F.col("created_on").alias("date"))
                  .agg(F.count(_one()).alias("w_cnt"))
                  .select("order_no", "date", F.lit(0).alias("side"), F.lit(None).cast("string").alias("notif_type"),
                          F.lit(None).cast("string").alias("criticality"), day.alias("n_cnt"), "w_cnt"))}
    line = side["n"].unionByName(side["w"]).withColumn("day", F.unix_date("date").cast("bigint"))
    since = (Window.partitionBy("order_no").orderBy(F.desc("date"), "side")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wide = T.DecimalType(38, 0)
    pairs = (line.withColumn("later", F.sum("w_cnt").over(since))
             .withColumn("later_days", F.sum(F.col("w_cnt") * F.col("day")).over(since))
             .filter((F.col("side") == 1) & (F.col("later") > 0)))
    g = (pairs.groupBy("notif_type", "criticality")
         .agg(F.sum((F.col("n_cnt") * (F.col("later_days") - F.col("later") * F.col("day"))).cast(wide)).alias("days"),
              F.sum(F.col("n_cnt") * F.col("later")).alias("cnt")))
    return g.select("notif_type", "criticality",
                    F.round(F.col("days").cast(wide) / F.col("cnt").cast(wide), 0).cast("int").alias("avg_days"),
                    F.col("cnt").cast("bigint").alias("cnt"))


def lead_time_matrix(lead: DataFrame) -> DataFrame:
    """Type x criticality matrix of ``avg_days`` (H, M, L columns, missing = 0)."""
    p = lead.groupBy("notif_type").pivot("criticality", LEAD_CRITICALITIES).agg(F.first("avg_days"))
    return p.select("notif_type", *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
                                    for c in LEAD_CRITICALITIES])


# ---------------------------------------------------------------- A4 overdue x WO category
WO_CATEGORIES = ["no_wo", "crtd", "rel", "teco"]


def _wo_category(w: DataFrame) -> Column:
    return (F.when(_done(w), "teco").when(tests_status(w, "REL"), "rel")
            .otherwise("crtd"))


def overdue_by_wo_status(n: DataFrame, w: DataFrame, as_of=None) -> DataFrame:
    """Overdue notifications by type and work-order category.

    Category precedence per join row: blank order -> no_wo, TECO/CLSD -> teco,
    REL -> rel, anything else (also no matching order) -> crtd.
    """
    cat = _wo_category(w)
    kinds = ("crtd", "rel", "teco")
    # One row per (type, key) meets one row per key: the join carries no
    # duplicates of a hot key, and each table is read once.
    od = (n.filter(F.col("required_end") < as_of_date(as_of)).groupBy("notif_type", "order_no")
          .agg(F.count(_one()).alias("n_cnt")))
    wk = (w.filter(not_blank("order_no")).groupBy("order_no")
          .agg(*[count_if(cat == c).alias(f"w_{c}") for c in kinds]))
    j = od.join(wk, "order_no", "left")
    blank, cnt = is_blank("order_no"), F.col("n_cnt")
    weights = {"no_wo": F.when(blank, cnt)}
    for c in kinds:
        none = F.lit(1 if c == "crtd" else 0)
        weights[c] = F.when(~blank, cnt * F.coalesce(F.col(f"w_{c}"), none))
    per_type = j.groupBy("notif_type").agg(*[F.sum(x).cast("bigint").alias(c) for c, x in weights.items()])
    tall = per_type.select("notif_type", F.inline(F.array(*[
        F.struct(F.lit(c).alias("wo_cat"), F.col(c).alias("cnt")) for c in WO_CATEGORIES])))
    return tall.filter(F.col("cnt") > 0)


def overdue_matrix(overdue: DataFrame) -> DataFrame:
    p = overdue.groupBy("notif_type").pivot("wo_cat", WO_CATEGORIES).agg(F.first("cnt"))
    return p.select("notif_type", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                    for c in WO_CATEGORIES])


# ---------------------------------------------------------------- A5/A6 trends
def trend_notifications(n: DataFrame, as_of=None, months: int = 6) -> DataFrame:
    """New notifications per month from the first day of (as_of - months+1)."""
    f = n.filter(F.col("notif_date") >= month_floor(as_of, months - 1))
    return f.groupBy(month_label("notif_date").alias("month")).agg(F.count(_one()).alias("cnt"))


def trend_finished(w: DataFrame, as_of=None, months: int = 6) -> DataFrame:
    f = w.filter((F.col("actual_finish") >= month_floor(as_of, months - 1))
                 & _done(w))
    return f.groupBy(month_label("actual_finish").alias("month")).agg(F.count(_one()).alias("cnt"))


def trend_merged(notif_trend: DataFrame, done_trend: DataFrame) -> DataFrame:
    """Union of both month sets, missing side = 0."""
    a = notif_trend.withColumnRenamed("cnt", "notif_cnt")
    b = done_trend.withColumnRenamed("cnt", "done_cnt")
    j = a.join(b, "month", "full")
    return j.select("month", F.coalesce("notif_cnt", F.lit(0)).cast("bigint").alias("notif_cnt"),
                    F.coalesce("done_cnt", F.lit(0)).cast("bigint").alias("done_cnt"))


# ---------------------------------------------------------------- A7 bad actors
def bad_actors(n: DataFrame, w: DataFrame, min_notifs: int = 3, top: int = 10) -> DataFrame:
    """Equipment with the most notifications (>= min_notifs), top-k, plus the
    number of distinct stagnant work orders (REL, no actual finish) on it.

    The many-to-many equipment join is replaced by per-side counts (``id`` is
    the row key of both tables, so rows are distinct): the top-k is decided on the notification side alone, and only the k
    winning equipments (a bounded list) are matched against work orders.
    """
    nk = (n.filter(not_blank("equipment")).groupBy("equipment")
          .agg(F.count(_one()).alias("notif_cnt"))
          .filter(F.col("notif_cnt") >= min_notifs)
          .orderBy(F.desc("notif_cnt"), F.asc("equipment")).limit(top))
    stagnant = (w.filter(tests_status(w, "REL") & F.col("actual_finish").isNull())
                .join(F.broadcast(nk.select("equipment")), "equipment", "left_semi")
                .groupBy("equipment").agg(F.count(_one()).alias("stagnant_wo")))
    return (nk.join(stagnant, "equipment", "left")
            .select("equipment", F.col("notif_cnt").cast("bigint").alias("notif_cnt"),
                    F.coalesce("stagnant_wo", F.lit(0)).cast("bigint").alias("stagnant_wo"))
            .orderBy(F.desc("notif_cnt"), F.asc("equipment")))


# ---------------------------------------------------------------- A8 WO status by type
def wo_status_by_type(w: DataFrame) -> DataFrame:
    return (w.filter(not_blank("order_type")).groupBy("order_type")
            .agg(count_if(tests_status(w, "CRTD") & ~tests_status(w, "REL")).alias("crtd"),
                 count_if(tests_status(w, "REL")).alias("rel"),
                 count_if(tests_status(w, "TECO")).alias("teco"),
                 count_if(tests_status(w, "CLSD")).alias("clsd"))
            .orderBy("order_type"))


def wo_kpi(w: DataFrame) -> DataFrame:
    """KPI "total WO" as the dashboard shows it (sum of the four non-exclusive
    counters over typed orders) next to the true row count."""
    typed = not_blank("order_type")
    return w.agg(
        (count_if(typed & tests_status(w, "CRTD") & ~tests_status(w, "REL"))
         + count_if(typed & tests_status(w, "REL"))
         + count_if(typed & tests_status(w, "TECO"))
         + count_if(typed & tests_status(w, "CLSD"))).alias("kpi_total_wo"),
        F.count(_one()).alias("row_count"))


# ---------------------------------------------------------------- A9 aging
def overdue_open_orders(w: DataFrame, as_of=None) -> DataFrame:
    """Work orders past basic finish and neither TECO nor CLSD (NULL status drops)."""
    return w.filter((F.col("basic_fin_date") < as_of_date(as_of))
                    & ~tests_status(w, "TECO") & ~tests_status(w, "CLSD"))


def wo_aging(w: DataFrame, as_of=None) -> DataFrame:
    days = days_between(as_of_date(as_of), F.col("basic_fin_date"))
    g = (overdue_open_orders(w, as_of).select(aging_bucket(days).alias("bucket"), days.alias("d"))
         .groupBy("bucket").agg(F.count(_one()).alias("cnt"), F.min("d").alias("_min_days")))
    return g.orderBy("_min_days").select("bucket", "cnt")


# ---------------------------------------------------------------- A10 / A11 top-k
def notification_status_top(n: DataFrame, top: int = 8) -> DataFrame:
    """Most frequent notification statuses; share is against the shown total.

    The share needs the sum over the k shown rows: a window over the
    already-limited top-k (at most ``top`` rows, one partition).
    """
    topk = (n.filter(F.col("system_status").isNotNull()).groupBy("system_status")
            .agg(F.count(_one()).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc("system_status")).limit(top))
    shown = F.sum("cnt").over(Window.partitionBy())
    return (topk.select("system_status", "cnt",
                        F.when(shown > 0, F.round(F.col("cnt") * 100.0 / shown))
                         .otherwise(F.lit(0.0)).cast("bigint").alias("share_pct"))
            .orderBy(F.desc("cnt"), F.asc("system_status")))


def backlog_by_workcenter(n: DataFrame, top: int = 10) -> DataFrame:
    return (n.filter(is_blank("order_no") & not_blank("main_workctr"))
            .groupBy(F.col("main_workctr").alias("workctr")).agg(F.count(_one()).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc("workctr")).limit(top))


# ---------------------------------------------------------------- A12 source summary
def source_summary(n: DataFrame, w: DataFrame, bom: DataFrame, cost: DataFrame) -> DataFrame:
    nul = F.lit(None).cast("bigint")

    def base(df, name, with_pr=nul, with_po=nul):
        return df.agg(F.lit(name).alias("source"), F.count(_one()).alias("total"),
                      F.max(F.col("uploaded_at").cast("timestamp_ntz")).alias("last_upload"),
                      with_pr.alias("with_pr"), with_po.alias("with_po"))

    parts = [base(n, "notifications"),
             base(w, "work_orders", count_if(not_blank("purc_req")), count_if(not_blank("po_number"))),
             base(bom, "bom"), base(cost, "cost_lines")]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- A13-A15 control-tower summaries
def wo_summary_by_type(w: DataFrame, as_of=None) -> DataFrame:
    overdue = ((F.col("basic_fin_date") < as_of_date(as_of))
               & ~tests_status(w, "TECO") & ~tests_status(w, "CLSD"))
    return (w.groupBy("order_type")
            .agg(F.count(_one()).alias("total"),
                 count_if(tests_status(w, "REL") & F.col("actual_finish").isNull()).alias("stagnant"),
                 count_if(tests_status(w, "TECO")).alias("teco"),
                 count_if(tests_status(w, "CLSD")).alias("closed"),
                 count_if(overdue).alias("overdue"))
            .orderBy(F.asc_nulls_last("order_type")))


def notification_summary(n: DataFrame) -> DataFrame:
    return (n.groupBy("system_status")
            .agg(F.count(_one()).alias("total"), count_if(is_blank("order_no")).alias("no_wo"))
            .orderBy(F.desc("total"), F.asc_nulls_last("system_status")))


def repeated_equipment(n: DataFrame, top: int = 15) -> DataFrame:
    """Equipment with more than one notification: count, distinct statuses
    (sorted, comma separated), latest required end; top-k by count.

    One scan: rows are first counted per (equipment, status), then per
    equipment, so a group never carries more than its distinct statuses.
    """
    per_status = (n.filter(not_blank("equipment")).groupBy("equipment", "system_status")
                  .agg(F.count(_one()).alias("cnt"), F.max("required_end").alias("last")))
    return (per_status.groupBy("equipment")
            .agg(F.sum("cnt").cast("bigint").alias("notif_count"),
                 F.sort_array(F.collect_list("system_status")).alias("all"),
                 F.max("last").alias("latest_req_end"))
            .filter(F.col("notif_count") > 1)
            .orderBy(F.desc("notif_count"), F.asc("equipment")).limit(top)
            .select("equipment", "notif_count",
                    F.when(F.size("all") > 0, F.array_join("all", ", ")).alias("statuses"), "latest_req_end")
            .orderBy(F.desc("notif_count"), F.asc("equipment")))


# ---------------------------------------------------------------- A16 filter values
def filter_values(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    return (df.filter(not_blank(column)).select(F.col(column).alias("value")).distinct()
            .orderBy("value").limit(limit))


# ---------------------------------------------------------------- A17 pack guard
def pack_has_data(backlog: DataFrame, stagnant: DataFrame, overdue_wo: DataFrame) -> DataFrame:
    """Sizes of the three (already limited) worklists; zero total = no data."""
    tagged = reduce(DataFrame.unionByName,
                    [df.select(F.lit(i).alias("_part")) for i, df in
                     enumerate([backlog, stagnant, overdue_wo])])
    sizes = tagged.agg(*[count_if(F.col("_part") == i).alias(name) for i, name in
                         enumerate(["backlog", "stagnant", "overdue_wo"])])
    total = F.col("backlog") + F.col("stagnant") + F.col("overdue_wo")
    return sizes.select("backlog", "stagnant", "overdue_wo", total.alias("total"),
                        (total > 0).alias("has_data"))


# ---------------------------------------------------------------- F19 status badge token
def status_token_counts(df: DataFrame) -> DataFrame:
    """Rows per first status token (lower case), the badge a status shows as."""
    tok = F.lower(F.split(F.trim(F.col("system_status")), r"\s+").getItem(0))
    return df.groupBy(tok.alias("token")).agg(F.count(_one()).alias("cnt"))
