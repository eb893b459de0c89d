"""Catalog tables, status flags, narrow pages and item rows: plans and results."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from upkeep.operators import analytics as A, builder as B, drilldown as D, packs as P, snapshots as S, worklists as W
from upkeep.functions.status import STATUS_WORDS, has_status, status_flag, tests_status as flag_or_text, with_status_flags
from upkeep.sources import catalog as C, fixtures as fx, ingest as I
from upkeep.sources.raw_exports import raw_export

AS_OF = "2001-06-30"


def rows(df):
    return sorted(map(str, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The fixture tables plain, and typed with flags in buckets of order_no."""
    root = tmp_path_factory.mktemp("buckets")
    n, w = fx.notifications(spark, SF_SMALL), fx.work_orders(spark, SF_SMALL)
    made = [C.write_bucketed(with_status_flags(df), f"test_{name}", 8, location=str(root / name)) for name, df in (("n", n), ("w", w))]
    yield (n, w), made
    for name in "nw":
        spark.sql(f"DROP TABLE test_{name}")


def exchanges_below_joins(df):
    """Exchanges on the sides of the topmost join of a plan."""
    lines = plan_of(df).split("== Initial")[0].split("\n")
    at = next(i for i, x in enumerate(lines) if "Join" in x and "Exchange" not in x)
    return sum("Exchange" in x for x in lines[at:])


@pytest.mark.parametrize("name", ["overdue_by_wo_status", "funnel_tail", "funnel_rel", "funnel_done", "funnel_has_wo"])
def test_buckets_join_without_an_exchange(spark, tables, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        build = {"overdue_by_wo_status": lambda n, w: A.overdue_by_wo_status(n, w, AS_OF)}.get(
            name, getattr(A, name, None) or getattr(D, name, None))
        plain, bucketed = tables
        assert rows(build(*bucketed)) == rows(build(*plain))
        assert exchanges_below_joins(build(*plain)) >= 2 and exchanges_below_joins(build(*bucketed)) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_key_in_buckets_is_one_row(spark, tmp_path):
    n = spark.range(30_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("order_no"),
                                   F.lit("M1").alias("notif_type"), F.lit(dt.date(2001, 1, 1)).alias("required_end"))
    w = spark.range(30_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("order_no"),
                                   F.lit("REL").alias("system_status"))
    sides = [C.write_bucketed(df, f"test_hot_{k}", 8, location=str(tmp_path / k)) for k, df in (("n", n), ("w", with_status_flags(w)))]
    got = [tuple(r) for r in A.overdue_by_wo_status(*sides, AS_OF).collect()]
    assert got == [("M1", "rel", 10_000 * 10_000 + 20_000)]
    for k in "nw":
        spark.sql(f"DROP TABLE test_hot_{k}")


def test_flags_keep_three_values(spark):
    df = with_status_flags(spark.createDataFrame([("crtd MANC",), ("REL teco",), (None,), ("",), ("xRELx",)], "system_status string"))
    for word in STATUS_WORDS:
        got = df.select(flag_or_text(df, word).alias("a"), has_status("system_status", word).alias("b")).collect()
        assert all(r["a"] == r["b"] and (r["a"] is None) == (r["b"] is None) for r in got)


@pytest.mark.parametrize("build,pushed", [
    (lambda n, w: W.stagnant(w), "EqualTo(status_rel,true)"), (lambda n, w: W.backlog(n), "EqualTo(status_osno,true)"),
    (lambda n, w: W.overdue_orders(w, AS_OF), "EqualTo(status_teco"), (lambda n, w: A.wo_aging(w, AS_OF), "EqualTo(status_teco"),
    (lambda n, w: W.pending_release(w), "EqualTo(status_crtd,true)"), (lambda n, w: A.trend_finished(w, AS_OF, 24), "status_teco"),
    (lambda n, w: D.wo_by_type_detail(w, "PT02", "clsd"), "EqualTo(status_clsd,true)"),
    (lambda n, w: D.funnel_rel(n, w), "EqualTo(status_rel,true)"), (lambda n, w: A.funnel_tail(n, w), "status_rel")])
def test_flags_reach_the_scan(spark, tables, build, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plain, flagged = tables
    plan = plan_of(build(*flagged))
    assert any(pushed in part.split("], ")[0] for part in plan.split("PushedFilters")[1:]), plan
    assert "ilike" not in plan.lower() and rows(build(*flagged)) == rows(build(*plain))


def test_ingest_writes_flags(spark, tmp_path):
    typed = I.clean_export(raw_export(spark, SF_SMALL, "work_orders"), "B1", dt.datetime(2001, 7, 1))
    root = str(tmp_path)
    I.write_tables({"work_order": typed}, root)
    table = spark.read.parquet(f"{root}/work_orders")
    assert status_flag("TECO") in table.columns
    assert table.where(~F.col("status_teco").eqNullSafe(has_status("system_status", "TECO"))).isEmpty()
    # A table begun without flags stays without them: a missing flag would read as NULL.
    old = str(tmp_path / "old")
    typed.write.partitionBy("upload_batch").parquet(f"{old}/work_orders")
    I.write_tables({"work_order": typed.withColumn("upload_batch", F.lit("B2"))}, old)
    assert not any(c.startswith("status_") for c in spark.read.option("mergeSchema", True).parquet(f"{old}/work_orders").columns)


def test_readers_see_one_version(spark, tmp_path):
    """Readers that run through replaces see one version or another, whole."""
    def version(k):
        return spark.range(2000).select(F.lit(k).alias("k"), F.col("id").cast("string").alias("order_no"))

    folder = str(tmp_path)
    C.replace_table(spark, version(0), "test_shown", 4, folder=folder)
    held = spark.table("test_shown")
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append([tuple(r) for r in spark.table("test_shown").groupBy("k").count().collect()])

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 4):
        C.replace_table(spark, version(k), "test_shown", 4, folder=folder)
    bad = spark.range(5).select(F.raise_error(F.lit("boom")).cast("int").alias("k"), F.col("id").cast("string").alias("order_no"))
    with pytest.raises(Exception):
        C.replace_table(spark, bad, "test_shown", folder=folder)
    stop.set()
    reader.join()
    assert seen and all(len(x) == 1 and x[0][1] == 2000 for x in seen)
    assert held.agg(F.max("k"), F.count("*")).first()[:] == (0, 2000)           # the version it was resolved to
    assert spark.table("test_shown").agg(F.max("k")).first()[0] == 3 and spark.catalog.tableExists("test_shown")
    complete = [v for v in C.versions(spark, "test_shown")]
    assert C.vacuum(spark, "test_shown", keep=2) == complete[:-2] and spark.table("test_shown").count() == 2000
    spark.sql("DROP VIEW test_shown")
    C.vacuum(spark, "test_shown", keep=0)
    assert not C.versions(spark, "test_shown") and not any("__v" in d and os.listdir(f"{folder}/{d}") for d in os.listdir(folder))


def test_periods_are_found_without_reading_rows(spark, tmp_path):
    path = str(tmp_path / "status")
    df = fx.view(spark, SF_SMALL, "asset_status")
    period = next(f.name for f in df.schema.fields if f.dataType.simpleString() in ("date", "string") and "period" in f.name or f.name == "report_date")
    C.write_snapshots(df, path, period)
    table = spark.read.parquet(path)
    for which in ("latest", "previous"):
        got = S.snapshot(table, period, which)
        cols = [c for c in df.columns if c != period]
        assert rows(got.select(cols)) == rows(S.snapshot(df, period, which).select(cols))
        plan = plan_of(got)
        assert "PartitionFilters: [isnotnull" in plan and "Subquery" in plan
    assert "ReadSchema: struct<>" in plan_of(table.select(F.max(period)))
    # A period that is written again is replaced, the others stay.
    last = table.agg(F.max(period)).first()[0]
    C.write_snapshots(df.where(F.col(period) == F.lit(last)).limit(3), path, period)
    assert spark.read.parquet(path).where(F.col(period) == F.lit(last)).count() == 3
    assert spark.read.parquet(path).where(F.col(period) != F.lit(last)).count() == df.where(F.col(period) != F.lit(last)).count()


def test_a_thousand_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3000).select("id", F.format_string("%04d/é", F.col("id") % 1000).alias("upload_batch"))
    df.repartition(1).write.partitionBy("upload_batch").parquet(path)
    assert C.compact_batches(spark, path, 100) == 10 and not C._folders(spark, path, "upload_batch")
    spark.createDataFrame([(9000, "0500/é"), (9001, "new")], "id bigint, upload_batch string").write.mode("append").partitionBy("upload_batch").parquet(path)
    assert C.read_batches(spark, path).count() == 3002
    before = {n: os.path.getmtime(f"{C.compacted_path(path)}/{n}") for n in os.listdir(C.compacted_path(path))}
    assert len(before) == 10
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(C.compacted_path(path)) for f in names)
    assert files <= 20
    assert C.delete_batch(spark, path, "0500/é") == 2                            # one open partition, one range
    after = {n: os.path.getmtime(f"{C.compacted_path(path)}/{n}") for n in os.listdir(C.compacted_path(path))}
    assert len(after) == 10 and sum(after.get(n) == t for n, t in before.items()) == 9
    left = C.read_batches(spark, path)
    assert left.count() == 2998 and left.where("upload_batch = '0500/é'").isEmpty()
    assert C.delete_batch(spark, path, "0500/é") == 0 and C.delete_batch(spark, path, "new") == 1


def test_joined_pages_by_the_whole_list(spark, tables):
    plain, _ = tables
    cases = {"funnel_has_wo": D.funnel_has_wo, "funnel_rel": D.funnel_rel, "funnel_done": D.funnel_done, "lead_time": D.lead_time_detail,
             "overdue": lambda n, w: D.overdue_detail(n, w, "M1", "rel", AS_OF),
             "bad_actor": lambda n, w: D.bad_actor_detail(n, w, plain[0].where("equipment is not null").first()["equipment"])}
    for name, build in cases.items():
        whole = build(*plain).collect()
        for page_no in (1, 2, 4000):
            got = D.joined_page(build, *plain, D.ORDERS[name], page_no, 25).collect()
            assert got == whole[(page_no - 1) * 25:page_no * 25], (name, page_no)


def test_a_page_carries_keys_below_its_limit(spark, tables):
    """The subquery that finds the page reads the order's columns and the key alone."""
    _, (n, w) = tables
    page = D.joined_page(D.funnel_has_wo, n, w, D.ORDERS["funnel_has_wo"], 3, 25)
    text = spark._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    main, below = text.split("===== Subqueries =====", 1)
    read = [x.split("struct<", 1)[1] for x in below.split("\n") if x.startswith("ReadSchema")]
    assert "TakeOrderedAndProject" in below and "description" in main
    assert read and all({c.split(":")[0] for c in x.rstrip(">").split(",")} <= {"id", "required_end", "order_no"} for x in read)


def test_item_rows_by_counting(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("k"), "id")
    got = P.pack_items({"s": (df, [F.desc("k"), "id"]), "none": (df.limit(0), ["id"])}).collect()
    want = [f'{{"k":{r["k"]},"id":{r["id"]}}}' for r in df.orderBy(F.desc("k"), "id").collect()]
    assert [r["payload"] for r in sorted(got, key=lambda r: r["position"])] == want
    assert [r["position"] for r in sorted(got, key=lambda r: r["position"])] == list(range(1, 5001))


def test_unlimited_sections_have_no_single_task(spark):
    from upkeep.plans import registry
    plan = plan_of(registry.queries()["pack_items"](spark, SF_SMALL))
    assert "Window" not in plan and "SinglePartition" not in plan.split("Subquery")[0]


def test_matrix_finds_its_series(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", None), (None, "x", 4), ("b", "—", 5)], "p string, g string, value int")
    got = {r["p"]: (r["legend"], r["cells"]) for r in B.pivot_matrix(df, "p", "g").collect()}
    legend = ["x", "y", "—"]
    assert got == {"a": (legend, [1, 0, 2]), "b": (legend, [0, None, 5]), None: (legend, [4, 0, 0])}
