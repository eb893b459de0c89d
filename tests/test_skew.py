"""One key holding a third of both sides: the pre-aggregated joins stay exact
(checked against the plain model) and never build the key's row pairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests import model
from tests.conftest import SF_SMALL
from upkeep.operators import analytics as A
from upkeep.sources import fixtures as fx

AS_OF = dt.date(2001, 6, 30)


@pytest.fixture(scope="module")
def skewed(spark):
    def hot(df, key):
        third = F.pmod(F.xxhash64(key), F.lit(3)) == 0
        return (df.withColumn("order_no", F.when(third, "1").otherwise(F.col("order_no")))
                .withColumn("equipment", F.when(third, "EQ1").otherwise(F.col("equipment"))).cache())
    n = hot(fx.notifications(spark, SF_SMALL), "id")
    w = hot(fx.work_orders(spark, SF_SMALL), "id")
    return n, w, [r.asDict() for r in n.collect()], [r.asDict() for r in w.collect()]


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_hot_key_funnel_tail(skewed):
    n, w, ns, ws = skewed
    same(A.funnel_tail(n, w), model.funnel_tail(ns, ws))


def test_hot_key_overdue(skewed):
    n, w, ns, ws = skewed
    same(A.overdue_by_wo_status(n, w, "2001-06-30"), model.overdue(ns, ws, AS_OF))


def test_hot_key_lead_time(skewed):
    n, w, ns, ws = skewed
    same(A.lead_time(n, w), model.lead_time(ns, ws))


def test_hot_equipment_bad_actors(skewed):
    n, w, ns, ws = skewed
    same(A.bad_actors(n, w), model.bad_actors(ns, ws, 3, 10))


def operator_rows(spark, df, kind):
    """Output rows of every operator of a kind in the plan that ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan().executedPlan()]     # the adaptive plan's final one
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "QueryStage" in name:
            todo.append(node.plan())
        metrics = node.metrics()
        if kind in name and metrics.contains("numOutputRows"):
            out.append(metrics.apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


@pytest.mark.parametrize("name", ["funnel_tail", "overdue", "lead_time"])
def test_rows_of_the_join_are_bounded_by_keys(spark, skewed, name):
    """What leaves a join (for lead time: enters the running sums) is one row
    per key and segment, however many rows the hot key has on either side."""
    n, w, ns, ws = skewed
    hot = sum(r["order_no"] == "1" for r in ns) * sum(r["order_no"] == "1" for r in ws)
    if name == "funnel_tail":
        rows, bound = operator_rows(spark, A.funnel_tail(n, w), "Join"), len({r["order_no"] for r in ns})
    elif name == "overdue":
        rows = operator_rows(spark, A.overdue_by_wo_status(n, w, "2001-06-30"), "Join")
        bound = len({(r["notif_type"], r["order_no"]) for r in ns})
    else:
        rows, bound = operator_rows(spark, A.lead_time(n, w), "Join") or [0], 0
    assert rows and max(rows) <= bound < hot


def test_overdue_reads_each_table_once(spark):
    n, w = fx.notifications(spark, SF_SMALL), fx.work_orders(spark, SF_SMALL)
    plan = A.overdue_by_wo_status(n, w, "2001-06-30")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == n._jdf.queryExecution().executedPlan().toString().count(
        "FileScan parquet") + w._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
