"""Edge cases on tiny in-memory frames: NULL/blank/tie/duplicate-key/overlap."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests import model
from upkeep.functions.buckets import bucket_dates
from upkeep.functions.display import display_format
from upkeep.functions.status import has_status, lacks_status
from upkeep.operators import analytics as A
from upkeep.operators import archive as R
from upkeep.operators import builder as B
from upkeep.operators import drilldown as Dd
from upkeep.operators import snapshots as S
from upkeep.sources import ingest as I

D = dt.date
AS_OF = D(2001, 6, 30)

N_SCHEMA = ("id bigint, notif_type string, notif_date date, order_no string, system_status string, "
            "required_end date, criticality string, equipment string, main_workctr string")
W_SCHEMA = ("id string, order_no string, system_status string, created_on date, actual_finish date, "
            "basic_fin_date date, equipment string, order_type string, total_plan_cost decimal(18,2), "
            "total_act_cost decimal(18,2)")


@pytest.fixture(scope="module")
def nw(spark):
    n = spark.createDataFrame([
        (1, "M1", D(2001, 1, 1), "100", "OSNO", D(2001, 2, 1), "H", "EQ1", "WC1"),
        (2, "M1", D(2001, 1, 5), "100", None, D(2001, 3, 1), "H", "EQ1", "WC1"),   # duplicate key
        (3, "M2", D(2001, 1, 9), "", "NOCO", D(2001, 4, 1), "M", "EQ1", ""),        # blank order
        (4, "M2", D(2001, 2, 1), None, "OSNO", None, "L", "", "WC2"),              # NULL order / end
        (5, "M3", D(2001, 2, 2), "200", "NOPR OSTS", D(2001, 5, 1), "I", "EQ2", "WC2"),
        (6, "M1", D(2001, 3, 3), "300", "OSNO", D(2001, 8, 1), "H", "EQ2", "WC1"),  # not overdue
        (7, "M3", D(2001, 2, 2), "999", "OSNO", D(2001, 5, 1), "M", "EQ1", "WC3"),  # no matching WO
    ], N_SCHEMA).select("*", F.concat(F.lit("N"), F.col("id").cast("string")).alias("notification"),
                        F.lit("req").alias("description"), F.lit("RU1").alias("location"))
    w = spark.createDataFrame([
        ("a", "100", "CRTD REL", D(2001, 1, 3), None, D(2001, 6, 1), "EQ1", "PT02", 10.0, 12.0),
        ("b", "100", "TECO REL", D(2000, 12, 1), D(2001, 2, 1), D(2001, 6, 29), "EQ1", "PT02", 5.0, None),
        ("c", "200", None, D(2001, 2, 10), None, D(2000, 1, 1), "EQ2", None, None, None),
        ("d", "200", "crtd manc", D(2001, 2, 20), None, D(2001, 6, 20), "EQ1", "PT03", 1.5, 1.0),
        ("e", "300", "CLSD", D(2001, 3, 5), D(2001, 4, 1), None, "EQ2", "", 2.0, 3.0),
    ], W_SCHEMA.replace("decimal(18,2)", "double")).select(
        *[F.col(c).cast("decimal(18,2)") if c.startswith("total") else F.col(c) for c in
          ["id", "order_no", "system_status", "created_on", "actual_finish", "basic_fin_date",
           "equipment", "order_type", "total_plan_cost", "total_act_cost"]],
        F.lit("H").alias("criticality"), F.lit("job").alias("description"), F.lit("RU1").alias("location"),
        F.lit("WC1").alias("main_workctr"))
    n.createOrReplaceTempView("tn")
    w.createOrReplaceTempView("tw")
    return n, w


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_status_three_valued(spark):
    df = spark.createDataFrame([("REL",), (None,), ("teco",)], "s string")
    assert df.filter(has_status(F.col("s"), "REL")).count() == 1
    assert df.filter(lacks_status(F.col("s"), "REL")).count() == 1  # NULL dropped by NOT ILIKE
    assert df.agg(A.count_if(has_status(F.col("s"), "TECO"))).first()[0] == 1


def test_joins_equal_model(nw):
    n, w = nw
    ns, ws = ([r.asDict() for r in df.collect()] for df in nw)
    assert rows(A.funnel_tail(n, w)) == model.funnel_tail(ns, ws)
    assert sorted(rows(A.overdue_by_wo_status(n, w, AS_OF))) == sorted(model.overdue(ns, ws, AS_OF))
    assert sorted(rows(A.lead_time(n, w))) == sorted(model.lead_time(ns, ws))


def test_bad_actors_equals_model(nw):
    n, w = nw
    ns, ws = ([r.asDict() for r in df.collect()] for df in nw)
    assert rows(A.bad_actors(n, w, min_notifs=2)) == model.bad_actors(ns, ws, 2, 10)


def test_repeated_equipment_status_list(nw):
    n, _ = nw
    r = {x.equipment: x for x in A.repeated_equipment(n).collect()}
    assert r["EQ1"].notif_count == 4
    assert r["EQ1"].statuses == "NOCO, OSNO"  # NULL status skipped, distinct, sorted
    assert r["EQ1"].latest_req_end == D(2001, 5, 1)


def test_aging_buckets_and_drill(spark, nw):
    _, w = nw
    # NULL status and TECO/CLSD rows drop out; both open overdue rows are 8-30 days late.
    assert rows(A.wo_aging(w, AS_OF)) == [("8-30 hari", 2)]
    assert Dd.aging_detail(w, "8-30 hari", AS_OF).count() == 2
    assert Dd.aging_detail(w, "weird", AS_OF).count() == 0   # unknown label -> >180
    dates = w.select(*[bucket_dates(label, F.lit(D(2001, 6, 27)), F.lit(D(2001, 6, 30))).alias(label)
                       for label in ("1-7 hari", "8-30 hari", ">180 hari")]).limit(1)
    assert rows(dates) == [(True, False, False)]


def test_builder_validation_and_filters(spark, nw):
    n, _ = nw
    with pytest.raises(ValueError):
        B.ChartSpec("nope", "notif_type").validated()
    with pytest.raises(ValueError):
        B.ChartSpec("notifications", "description").validated()
    with pytest.raises(ValueError):
        B.ChartSpec("notifications", "notif_type", "sum_plan").validated()
    with pytest.raises(ValueError):
        B.ChartSpec("notifications", "notif_type", group_col="notif_type").validated()
    with pytest.raises(ValueError):
        B.ChartSpec("notifications", "notif_type", top_n=0).validated()
    assert B.ChartSpec("notifications", "notif_type", top_n=500).validated().top_n == 50
    spec = B.ChartSpec("notifications", "notif_type", "count",
                       filters=(B.ChartFilter("main_workctr", "WC1"), B.ChartFilter("location", ""),
                                B.ChartFilter("order_no", "100")))
    assert rows(B.build_chart(n, spec)) == [("M1", 3)]


def test_pivot_missing_zero_but_null_kept(spark, nw):
    _, w = nw
    spec = B.ChartSpec("work_orders", "order_type", "sum_plan", "system_status")
    g = B.build_chart(w, spec)
    p = B.pivot_chart(g, "order_type", "system_status",
                      sorted({r.system_status or "—" for r in g.collect()}))
    cols = p.columns
    assert cols[0] == "order_type" and cols[-1] == "—"      # NULL series shown as dash, sorted last
    r = {x.order_type: x.asDict() for x in p.collect()}
    assert r[None]["—"] is None          # existing cell whose aggregate is NULL
    assert r["PT02"]["CLSD"] == 0        # missing combination


def test_ungrouped_null_value_first(spark, nw):
    _, w = nw
    out = B.build_chart(w, B.ChartSpec("work_orders", "order_type", "sum_actual")).collect()
    assert out[0].value is None


def test_paging(spark, nw):
    n, _ = nw
    assert Dd.clamp_paging(0, 5) == (1, 10)
    assert Dd.clamp_paging(3, 1000) == (3, 100)
    ordered = n.orderBy("id")
    first = [r.id for r in Dd.page(ordered, 1, 10).collect()]
    assert first == [1, 2, 3, 4, 5, 6, 7]
    ks = Dd.page_after(n, [("id", True)], (3,), 10).collect()
    assert [r.id for r in ks] == [4, 5, 6, 7]
    info = Dd.page_info(n, 10).first()
    assert (info.total, info.total_pages) == (7, 1)


def test_status_top_share(nw):
    n, _ = nw
    r = A.notification_status_top(n, top=2).collect()
    assert [x.system_status for x in r] == ["OSNO", "NOCO"]  # tie NOCO/NOPR OSTS broken by name
    assert [x.share_pct for x in r] == [80, 20]


def test_snapshots(spark):
    t = spark.createDataFrame([(1, "2024-01-01", "A", "closed"), (2, "2024-01-02", "A", "open"),
                               (3, "2024-01-02", "B", None), (4, "2024-01-01", "C", "x")],
                              "id bigint, periode string, tag_number string, status string")
    assert rows(S.snapshot(t, "periode").select("id")) == [(2,), (3,)]
    assert rows(S.snapshot(t, "periode", "previous").select("id")) == [(1,), (4,)]
    cur = S.snapshot(t, "periode").filter(S.not_in("status", S.BAD_ACTOR_CLOSED))
    tr = rows(S.bad_actor_trend(cur, S.snapshot(t, "periode", "previous")))
    assert tr == [("A", "recurring"), ("B", "new")]
    one = t.filter(F.col("periode") == "2024-01-01")
    assert S.snapshot(one, "periode", "previous").count() == 0


def test_digest(spark):
    reports = spark.createDataFrame([(1, "daily", "alpha", dt.datetime(2024, 1, 5)),
                                     (2, "weekly", "beta", dt.datetime(2024, 1, 7))],
                                    "id bigint, type string, content string, created_at timestamp_ntz")
    memos = spark.createDataFrame([(10, "m", [1, 2, 99], "c", dt.datetime(2024, 2, 1))],
                                  "id bigint, title string, source_report_ids array<int>, content string, "
                                  "created_at timestamp_ntz")
    d = R.report_digest(memos, reports).first()
    assert d.n_sources == 2
    assert d.digest == ("[WEEKLY REPORT — 07 Jan 2024]\nbeta\n\n" + "=" * 60 + "\n\n"
                        "[DAILY REPORT — 05 Jan 2024]\nalpha")
    assert R.latest_of_type(reports, "daily").first().excerpt == "alpha"


def test_without_batch_keeps_null(spark):
    df = spark.createDataFrame([("B1",), ("B2",), (None,)], "upload_batch string")
    assert rows(I.without_batch(df, "B1")) == [("B2",), (None,)]


def test_display_format(spark):
    df = spark.createDataFrame([(1, 2.345, D(2001, 1, 2), None, True)],
                               "a bigint, b double, c date, d string, e boolean")
    assert tuple(display_format(df).first()) == ("1.0", "2.35", "2001-01-02", "—", "1.0")


def test_trend_merged_fills_zero(spark):
    a = spark.createDataFrame([("2001-01", 3)], "month string, cnt bigint")
    b = spark.createDataFrame([("2001-02", 4)], "month string, cnt bigint")
    assert rows(A.trend_merged(a, b)) == [("2001-01", 3, 0), ("2001-02", 0, 4)]


def test_detail_dispatcher(spark, nw):
    n, w = nw
    assert Dd.detail(n, w, "funnel", {"segment": "total_notif"}).count() == 7
    assert Dd.detail(n, w, "funnel").count() == 2            # default segment no_wo
    assert Dd.detail(n, w, "overdue", {"notif_type": "M1", "wo_cat": "bogus"}, AS_OF).count() == 0
    with pytest.raises(ValueError):
        Dd.detail(n, w, "funnel", {"segment": "nope"})
    with pytest.raises(ValueError):
        Dd.detail(n, w, "nope")


def test_missing_table_is_empty_section(spark, tmp_path):
    from upkeep.sources.tables import load_or_empty
    df = load_or_empty(spark, "no_such_table", "ru string, periode date", str(tmp_path / "absent"))
    assert df.count() == 0 and df.columns == ["ru", "periode"]
    spark.createDataFrame([("RU1", D(2024, 1, 1))], "ru string, periode date").write.parquet(str(tmp_path / "p"))
    assert load_or_empty(spark, "no_such_table", "ru string, periode date", str(tmp_path / "p")).count() == 1


def test_append_artifact_and_local_stamp(spark, tmp_path):
    schema = "id bigint, type string, content string, created_at timestamp_ntz"
    path = str(tmp_path / "reports")
    for i in (1, 2):
        R.append_artifact(spark, path, {"id": i, "type": "daily", "content": f"r{i}",
                                        "created_at": dt.datetime(2024, 1, i, 17, 30)}, schema)
    r = spark.read.parquet(path)
    assert r.count() == 2
    stamp = r.filter("id = 1").select(R.local_stamp(F.col("created_at"))).first()[0]
    assert stamp == "02 Jan 2024 00.30"   # 17:30 UTC is 00:30 next day at UTC+7


def test_control_tower_outputs_list(spark):
    ct = spark.createDataFrame(
        [(1, "control_tower", "t1", "x" * 300, dt.datetime(2024, 1, 1)),
         (2, "memo", "t2", "y", dt.datetime(2024, 1, 2)),
         (3, "control_tower", "t3", "z", dt.datetime(2024, 1, 3))],
        "id bigint, output_type string, title string, content string, created_at timestamp_ntz")
    out = R.archive_list(ct, "output_type", "control_tower", limit=50, extra=("title",)).collect()
    assert [r.id for r in out] == [3, 1]
    assert out[0].asDict().keys() == {"id", "output_type", "title", "preview", "created_at"}
    assert len(out[1].preview) == 200


def test_long_text_flag_cells(spark):
    from upkeep.functions.cleaners import long_text_flag
    from pyspark.sql import types as T
    txt = spark.createDataFrame([(" X ",), ("True",), ("no",), (None,), ("1",)], "c string")
    assert [r[0] for r in txt.select(long_text_flag(F.col("c"))).collect()] == [True, True, False, False, True]
    b = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    got = [r[0] for r in b.select(long_text_flag(F.col("c"), T.BooleanType())).collect()]
    assert got == [True, False, False]


def test_filter_values_catalog(spark, nw):
    n, _ = nw
    assert [r.value for r in B.filter_values(n, "notifications", "main_workctr").collect()] == ["WC1", "WC2", "WC3"]
    with pytest.raises(ValueError):
        B.filter_values(n, "notifications", "description")
    with pytest.raises(ValueError):
        B.filter_values(n, "nope", "main_workctr")


def test_pack_of_a_missing_table_has_an_empty_section(spark):
    from upkeep.operators.packs import pack_json
    secs = S.SECTIONS["daily"]
    built = S.gather({}, "daily", spark)
    out = pack_json({name: (built[name], [F.asc_nulls_last(c) for c in sec.order] + ["id"])
                     for name, sec in secs.items()}).collect()
    assert sorted(r.section for r in out) == sorted(secs) and all((r.n_rows, r.payload) == (0, "[]") for r in out)


def test_the_pack_has_every_section(spark):
    from tests.conftest import SF_SMALL
    from upkeep.plans import q_archive, registry
    rows = {r.section: r for r in registry.queries()["pack_json"](spark, SF_SMALL).collect()}
    names = {name for name, *_ in q_archive._PACK}
    assert set(rows) == names and len(names) == 8
    assert all(f"'{name}' AS section" in registry.oracle_sql()["pack_json"] for name in names)
    assert all(len(json.loads(r.payload)) == r.n_rows for r in rows.values()) and rows["wo_summary_by_type"].n_rows > 1


def test_months_are_half_open_ranges(spark):
    from upkeep.functions.status import in_month
    days = [D(2001, 1, 31), D(2001, 2, 1), D(2001, 2, 28), D(2001, 3, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r.d for r in df.filter(in_month("d", "2001-02")).collect()] == days[1:3]
    assert df.filter(in_month("d", "2001-12")).count() == df.filter(in_month("d", "nonsense")).count() == 0
