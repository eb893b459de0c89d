"""Property tests: the per-key pre-aggregated joins equal the plain model on
random inputs with duplicate keys, hot keys, blanks and NULLs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests import model
from upkeep.operators import analytics as A
from upkeep.operators import builder as B

KEYS = st.sampled_from([None, "", "1", "2", "3", "hot"])
STATUS = st.sampled_from([None, "REL", "CRTD", "CRTD REL", "TECO REL", "CLSD", "teco", "osno"])
DATES = st.one_of(st.none(), st.dates(dt.date(2001, 5, 1), dt.date(2001, 8, 1)))
TYPES = st.sampled_from(["M1", "M2", "M3", "M4"])
CRIT = st.sampled_from([None, "H", "M", "L", "I"])

N_ROW = st.tuples(TYPES, DATES, KEYS, DATES, CRIT, st.sampled_from(["", "EQ1", "EQ2", None]))
W_ROW = st.tuples(KEYS, STATUS, DATES, DATES, st.sampled_from(["EQ1", "EQ2", "EQ3"]))

N_SCHEMA = "notif_type string, notif_date date, order_no string, required_end date, criticality string, equipment string"
W_SCHEMA = "order_no string, system_status string, created_on date, actual_finish date, equipment string"
SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def frames(spark, nrows, wrows):
    n = spark.createDataFrame([(i, *r) for i, r in enumerate(nrows)], "id bigint, " + N_SCHEMA)
    w = spark.createDataFrame([(f"w{i}", *r) for i, r in enumerate(wrows)], "id string, " + W_SCHEMA)
    return n, w


def norm(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@SETTINGS
@given(st.lists(N_ROW, max_size=25), st.lists(W_ROW, max_size=25))
def test_joins_equal_the_model(spark, nrows, wrows):
    n, w = frames(spark, nrows, wrows)
    ns, ws, day = rows_of(n), rows_of(w), dt.date(2001, 6, 30)
    for got, want in [(A.funnel_tail(n, w), model.funnel_tail(ns, ws)),
                      (A.overdue_by_wo_status(n, w, day), model.overdue(ns, ws, day)),
                      (A.lead_time(n, w), model.lead_time(ns, ws)),
                      (A.bad_actors(n, w, min_notifs=1, top=10), model.bad_actors(ns, ws, 1, 10))]:
        assert norm(got) == sorted(want, key=repr)


@SETTINGS
@given(st.lists(N_ROW, min_size=1, max_size=25))
def test_pivot_totals_equal_tall(spark, nrows):
    n, _ = frames(spark, nrows, [])
    spec = B.ChartSpec("notifications", "notif_type", "count", "criticality")
    tall = B.build_chart(n, spec)
    wide = B.pivot_chart(tall, "notif_type", "criticality", ["H", "I", "L", "M", "—"])
    long = B.pivot_long(tall, "notif_type", "criticality")
    total_wide = sum(sum(v for k, v in r.asDict().items() if k != "notif_type") for r in wide.collect())
    assert total_wide == sum(r.value for r in tall.collect()) == len(nrows)
    assert sum(r.value for r in long.collect()) == len(nrows)
    assert long.count() == len({r[0] for r in nrows}) * len({r[4] for r in nrows})


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.integers(0, 3))),
                min_size=1, max_size=40, unique=True),
       st.integers(1, 4))
def test_keyset_paging_equals_offset_paging(spark, keys, page_no):
    from upkeep.operators import drilldown as Dd
    df = spark.createDataFrame(keys, "a int, b int")
    order = [("a", False), ("b", True)]
    ordered = df.orderBy(df.a.desc_nulls_last(), df.b.asc_nulls_last())
    pages = [[tuple(r) for r in Dd.page(ordered, p, 10).collect()] for p in range(1, page_no + 1)]
    last, walked = None, []
    for _ in range(page_no):
        rows = [tuple(r) for r in Dd.page_after(df, order, last, 10).collect()]
        walked.append(rows)
        if rows:
            last = rows[-1]
    assert walked == pages


def test_wide_cleaning_is_compiled_in_any_session(spark):
    """A launcher's session has Spark's own limit, above which methods stay interpreted."""
    from tests.conftest import SF_SMALL
    from upkeep.sources import ingest
    from upkeep.sources.raw_exports import raw_export
    key, kept = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        for given, want in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, given)
            ex = raw_export(spark, SF_SMALL, "work_orders")
            assert spark.conf.get(key) == want
            spark.conf.set(key, given)
            ingest.clean_export(ex, "B")
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, kept)


def test_trimmed_ends_of_every_kind(spark):
    from pyspark.sql import functions as F
    from upkeep.functions.cleaners import WHITESPACE, clean_number, clean_string
    ends = ["", "a", "~", "!", "\x7f", "é", "\u200b", *WHITESPACE]
    texts = [a + mid + b for a in ends for b in ends for mid in ("", "x y")] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", clean_string(F.col("t")).alias("v")).collect()}
    assert got == {i: (t.strip() or None) if t is not None else None for i, t in enumerate(texts)}
    numbers = spark.createDataFrame([(x,) for x in ("n/a", "NaN", "Infinity", " 1.005 ", "+2", "-.5", "1e2", "", "[", "٣", None)], "t string")
    plain = F.btrim("t", F.lit(WHITESPACE)).try_cast("decimal(18,2)")
    assert all(r.a == r.b for r in numbers.select(clean_number(F.col("t")).alias("a"), plain.alias("b")).collect())
