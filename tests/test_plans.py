"""Physical plan shape of the registered queries."""

import pytest

import __spark_entry__ as E
from upkeep.plans import registry
from tests.conftest import SF_SMALL
from upkeep.operators import worklists as W

KEYS = sorted(registry.queries())
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_python_udf_no_cartesian(spark, key):
    plan = plan_text(E.queries()[key](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{key}: {bad}"


@pytest.mark.parametrize("key", ["ct_backlog", "ct_stagnant", "backlog_by_workcenter", "snap_paf",
                                 "reports_list", "builder_topn"])
def test_topk_is_take_ordered(spark, key):
    assert "TakeOrderedAndProject" in plan_text(E.queries()[key](spark, SF_SMALL))


def test_column_pruning(spark):
    plan = plan_text(E.queries()["funnel_head"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_join_side_preaggregated(spark):
    # Both sides are aggregated per key before the join: no join over raw rows.
    plan = plan_text(E.queries()["funnel_tail"](spark, SF_SMALL))
    assert plan.count("HashAggregate") >= 4


def test_filters_reach_parquet_on_typed_tables(spark, tmp_path):
    from upkeep.sources.ingest import clean_export
    from upkeep.sources.raw_exports import raw_export
    n = clean_export(raw_export(spark, SF_SMALL, "notifications"), "B1", row_id_prefix="B1-0")
    path = str(tmp_path / "n")
    n.write.parquet(path)
    ids = spark.read.parquet(path).select("id")
    assert ids.distinct().count() == ids.count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = W.overdue_notifications(spark.read.parquet(path), "2001-06-30")
    plan = plan_text(df)
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "LessThan(required_end,2001-06-30)" in pushed
    assert "Or(IsNull(order_no),EqualTo(order_no,))" in pushed


def test_date_ranges_reach_the_scan(spark, tmp_path):
    """Month and aging drill-downs push both bounds on a typed table."""
    from upkeep.operators import drilldown as Dd
    from upkeep.sources.ingest import clean_export
    from upkeep.sources.raw_exports import raw_export
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    paths = {}
    for view in ("notifications", "work_orders"):
        paths[view] = str(tmp_path / view)
        clean_export(raw_export(spark, SF_SMALL, view), "B1", row_id_prefix="B1-0").write.parquet(paths[view])
    n, w = (spark.read.parquet(paths[v]) for v in ("notifications", "work_orders"))
    for df, column, low, high in [
            (Dd.trend_notif_detail(n, "2001-05"), "notif_date", "2001-05-01", "2001-06-01"),
            (Dd.trend_done_detail(w, "2001-05"), "actual_finish", "2001-05-01", "2001-06-01"),
            (Dd.aging_detail(w, "31-90 hari", "2001-06-30"), "basic_fin_date", "2001-04-01", "2001-05-30")]:
        plan = plan_text(df)
        pushed = plan[plan.index("PushedFilters"):].split("]")[0]
        assert f"GreaterThanOrEqual({column},{low})" in pushed
        assert f"LessThan({column},{high})" in pushed or f"LessThanOrEqual({column},{high})" in pushed


def test_walking_the_pages_gives_the_whole_list(spark):
    from upkeep.operators import drilldown as Dd
    from upkeep.sources import fixtures as fx
    n, w = fx.notifications(spark, SF_SMALL), fx.work_orders(spark, SF_SMALL)
    for name, df in (("funnel_no_wo", Dd.funnel_no_wo(n)), ("funnel_done", Dd.funnel_done(n, w))):
        df, order = df.limit(330).cache(), Dd.ORDERS[name]
        whole, walked, last = [tuple(r) for r in df.collect()], [], None
        while page := Dd.page_after(df, order, last, 100).collect():
            walked += [tuple(r) for r in page]
            last = tuple(page[-1][c] for c, _ in order)
        assert walked == whole
