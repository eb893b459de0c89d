"""Ad-hoc group-by builder: a declarative chart spec compiled to a DataFrame plan.

The spec names a table, a dimension, a measure, an optional second
dimension, equality filters and a top-N.  Everything is checked against a
fixed catalog and compiled to ``Column`` expressions; no SQL text is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.display import NULL_MARK
from upkeep.functions.status import as_of_date, is_blank, lacks_status, not_blank

# The builder catalog (allowed dimensions, filter columns, measures).
X_COLS = {
    "notifications": ["notif_type", "system_status", "criticality", "location", "main_workctr",
                      "planner_group"],
    "work_orders": ["order_type", "system_status", "criticality", "location", "main_workctr",
                    "plant", "priority", "planner_group"],
}
FILTER_COLS = {
    "notifications": ["notif_type", "system_status", "criticality", "location", "main_workctr",
                      "planner_group"],
    "work_orders": ["order_type", "system_status", "criticality", "location", "main_workctr",
                    "plant", "priority"],
}
MEASURES = {
    "notifications": ["count", "count_with_wo", "count_no_wo", "count_overdue", "pct_with_wo"],
    "work_orders": ["count", "sum_plan", "sum_actual", "avg_plan", "avg_actual", "cost_overrun",
                    "count_overdue"],
}
DEFAULT_TOP_N = 20
MAX_TOP_N = 50


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _money(c: Column) -> Column:
    return F.round(c, 0).cast("double")


def measure(table: str, key: str, as_of=None) -> Column:
    """The aggregate ``Column`` of one catalog measure, aliased ``value``."""
    if table == "notifications":
        has_wo = not_blank("order_no")
        m = {
            "count": lambda: F.count(F.lit(1)),
            "count_with_wo": lambda: _count_if(has_wo),
            "count_no_wo": lambda: _count_if(is_blank("order_no")),
            "count_overdue": lambda: _count_if(F.col("required_end") < as_of_date(as_of)),
            "pct_with_wo": lambda: F.round(
                F.lit(100.0) * F.sum(F.when(has_wo, 1).otherwise(0)).cast("double")
                / F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double"), 1),
        }
    else:
        st = F.col("system_status")
        plan, act = F.col("total_plan_cost"), F.col("total_act_cost")
        m = {
            "count": lambda: F.count(F.lit(1)),
            "sum_plan": lambda: _money(F.sum(plan)),
            "sum_actual": lambda: _money(F.sum(act)),
            "avg_plan": lambda: _money(F.avg(plan)),
            "avg_actual": lambda: _money(F.avg(act)),
            "cost_overrun": lambda: _money(F.sum(act - plan)),
            "count_overdue": lambda: _count_if((F.col("basic_fin_date") < as_of_date(as_of))
                                               & lacks_status(st, "TECO") & lacks_status(st, "CLSD")),
        }
    return m[key]().alias("value")


@dataclass(frozen=True)
class ChartFilter:
    col: str
    val: Any


@dataclass(frozen=True)
class ChartSpec:
    table: str = "notifications"
    x_col: str = ""
    agg: str = "count"
    group_col: str | None = None
    filters: tuple[ChartFilter, ...] = field(default_factory=tuple)
    top_n: int = DEFAULT_TOP_N

    def validated(self) -> "ChartSpec":
        if self.table not in X_COLS:
            raise ValueError(f"invalid table: {self.table}")
        if self.x_col not in X_COLS[self.table]:
            raise ValueError(f"invalid x_col: {self.x_col}")
        if self.agg not in MEASURES[self.table]:
            raise ValueError(f"invalid aggregation: {self.agg}")
        if self.group_col and self.group_col not in X_COLS[self.table]:
            raise ValueError(f"invalid group_col: {self.group_col}")
        if self.group_col and self.group_col == self.x_col:
            raise ValueError("group_col must differ from x_col")
        top_n = int(self.top_n)
        if top_n < 1:
            raise ValueError("top_n must be >= 1")
        return ChartSpec(self.table, self.x_col, self.agg, self.group_col or None,
                         tuple(self.filters), min(top_n, MAX_TOP_N))

    def predicate(self) -> Column | None:
        """AND of the usable equality filters (value compared as text).

        Filters with an empty column, an empty/None value or a column outside
        the catalog are skipped silently.
        """
        allowed = FILTER_COLS[self.table]
        parts = [F.col(f.col) == F.lit(str(f.val)) for f in self.filters
                 if f.col and f.val is not None and f.val != "" and f.col in allowed]
        return reduce(lambda a, b: a & b, parts) if parts else None


def build_chart(df: DataFrame, spec: ChartSpec, as_of=None) -> DataFrame:
    """Ungrouped: top-N by value (NULL value first).  Grouped: every (x, g)
    cell ordered by x (NULL last) then value descending (NULL first)."""
    spec = spec.validated()
    pred = spec.predicate()
    src = df.filter(pred) if pred is not None else df
    value = measure(spec.table, spec.agg, as_of)
    x = spec.x_col
    if spec.group_col:
        g = spec.group_col
        return (src.groupBy(x, g).agg(value)
                .orderBy(F.asc_nulls_last(x), F.desc_nulls_first("value"), F.asc_nulls_last(g)))
    return (src.groupBy(x).agg(value)
            .orderBy(F.desc_nulls_first("value"), F.asc_nulls_last(x)).limit(spec.top_n))


def pivot_long(grouped: DataFrame, x_col: str, group_col: str) -> DataFrame:
    """Dense long form ``(x, series, value)`` of a grouped chart, lazily and for
    any number of series: every x with every series, a missing combination as
    0, a NULL aggregate as NULL, a NULL series as the dash.

    The x values and the series are lists of distinct labels; the matrix of
    both is the result's own size.  Each x carries the list of series, which
    is aggregated once and joined on a constant key.
    """
    cells = grouped.select(F.col(x_col).alias("x"), F.coalesce(F.col(group_col).cast("string"), F.lit(NULL_MARK))
                           .alias("series"), "value")
    names = cells.agg(F.sort_array(F.collect_set("series")).alias("names"))
    dense = (cells.select("x").distinct().withColumn("series", F.explode(names.scalar())))
    have = cells.groupBy("x", "series").agg(F.first("value").alias("value"), F.lit(1).alias("there"))
    kind = grouped.schema["value"].dataType
    d, h = dense.alias("d"), have.alias("h")
    return (d.join(h, F.col("d.x").eqNullSafe(F.col("h.x")) & (F.col("d.series") == F.col("h.series")), "left")
            .select(F.col("d.x").alias(x_col), F.col("d.series").alias("series"),
                    F.when(F.col("there").isNull(), F.lit(0).cast(kind)).otherwise(F.col("value")).alias("value"))
            .orderBy(F.asc_nulls_last(x_col), "series"))


def pivot_chart(grouped: DataFrame, x_col: str, group_col: str, series: list[str]) -> DataFrame:
    """Dense x-by-series matrix of a grouped chart for the given series (the
    chart's legend; any number).  For series that are not known beforehand
    there is ``pivot_long``.

    A missing (x, series) combination is 0; a cell whose aggregate is NULL
    stays NULL.  Rows follow the grouped order (x ascending, NULL last).
    """
    tall = grouped.select(x_col, F.coalesce(F.col(group_col).cast("string"), F.lit(NULL_MARK)).alias("_g"),
                          "value")
    kind = grouped.schema["value"].dataType
    cells = []
    for i, s in enumerate(series):
        hit = F.col("_g") == F.lit(s)
        cells += [F.max(F.when(hit, F.col("value"))).alias(f"v{i}"), F.count(F.when(hit, 1)).alias(f"n{i}")]
    wide = tall.groupBy(x_col).agg(F.lit(0).alias("_"), *cells)
    return (wide.select(x_col, *[F.when(F.col(f"n{i}") == 0, F.lit(0).cast(kind)).otherwise(F.col(f"v{i}")).alias(s)
                                 for i, s in enumerate(series)])
            .orderBy(F.asc_nulls_last(x_col)))


def pivot_matrix(grouped: DataFrame, x_col: str, group_col: str) -> DataFrame:
    """Wide form with the series found in the data: per x the ``legend`` (all
    series, sorted, the same in every row) and ``cells``, one value for each.

    Lazy and without a driver read: the legend is a scalar subquery, and a row
    looks its values up in a map of its own cells.  A missing combination is
    0, a NULL aggregate NULL, a NULL series the dash.
    """
    kind = grouped.schema["value"].dataType
    own = grouped.select(F.col(x_col), F.coalesce(F.col(group_col).cast("string"), F.lit(NULL_MARK)).alias("_g"), "value")
    legend = own.agg(F.sort_array(F.collect_set("_g"))).scalar()
    # A series that is named like the dash meets the NULL one: one value of both.
    rows = own.groupBy(x_col, "_g").agg(F.first("value").alias("value")).groupBy(x_col).agg(F.map_from_entries(F.collect_list(F.struct("_g", "value"))).alias("_of"))
    return (rows.withColumn("legend", legend)
            .select(x_col, "legend", F.transform("legend", lambda s: F.when(
                F.map_contains_key("_of", s), F.element_at("_of", s)).otherwise(F.lit(0).cast(kind))).alias("cells"))
            .orderBy(F.asc_nulls_last(x_col)))


def filter_values(df: DataFrame, table: str, column: str, limit: int = 200) -> DataFrame:
    """Distinct non-blank values of a catalog filter column, sorted, first 200
    (the filter drop-down).  Unknown tables or columns raise ``ValueError``."""
    from upkeep.operators.analytics import filter_values as distinct_values
    if table not in FILTER_COLS:
        raise ValueError(f"invalid table: {table}")
    if column not in FILTER_COLS[table]:
        raise ValueError(f"invalid column: {column}")
    return distinct_values(df, column, limit)
