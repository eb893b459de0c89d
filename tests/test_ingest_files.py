"""Ingest from real export files: headers, duplicates, blanks, modes, batches."""

import datetime as dt
import os

import pytest

from upkeep.sources import ingest as I
from upkeep.sources.exports import detect_kind, header_position

NOTIF_CSV = """Notifictn type,Notif.date,Notification,System status,Order,Description,Unknown col,Long text
M1,2001-01-05,10001,OSNO,  4711  ,pump leaks,zzz,X
M2,2024-13-40,10002,,,"multi
line text",,
,,,,,,,
M3-TOO-LONG-TYPE,2001-02-01,10003,NOCO,n/a,  ,q,no
"""

BOM_CSV = """Equipment,Description,BOM category,Component,Description,Quantity,Item text,ITEM TEXT
EQ1,Pump A,M,MAT1,Seal kit,2.5,first,second
EQ2,Pump B,M,MAT2,Bearing,n/a,,other
"""

UNKNOWN_CSV = """Foo,Bar
1,2
"""


@pytest.fixture()
def files(tmp_path):
    paths = {}
    for name, body in [("notif.csv", NOTIF_CSV), ("bom.csv", BOM_CSV), ("other.csv", UNKNOWN_CSV),
                       ("readme.txt", "x")]:
        p = tmp_path / name
        p.write_text(body)
        paths[name] = str(p)
    return paths


def test_detect_kind_rules():
    assert detect_kind(["Notification", "Order"]) == "notification"
    assert detect_kind(["Notification", "Order Type", "Bas. start date"]) == "work_order"
    assert detect_kind([" Notifictn type ", "Order Type"]) == "notification"
    assert detect_kind(["Order Type"]) == "unknown"
    assert detect_kind(["BOM category", "Component"]) == "bom"
    assert detect_kind(["WBS Element", "Cost Element", "Project Definition"]) == "cji3"
    assert detect_kind([None, ""]) == "unknown"


def test_header_positions():
    h = ["Description", "x", "Description", "Item Text", "item text"]
    assert header_position(h, "Description#1") == 0
    assert header_position(h, "Description#2") == 2
    assert header_position(h, "Description#3") is None
    assert header_position(h, "item text~i") == 3
    assert header_position(h, "Missing") is None


def test_notification_file(spark, files):
    ex = I.read_csv_export(spark, files["notif.csv"])
    assert ex.kind == "notification"
    df = I.clean_export(ex, "b1", dt.datetime(2001, 7, 1))
    rows = {r.notification: r for r in df.collect()}
    assert len(rows) == 3                             # the all-empty row vanished
    a = rows["10001"]
    assert (a.order_no, a.notif_date, a.has_long_text, a.required_end) == ("4711", dt.date(2001, 1, 5), True, None)
    b = rows["10002"]
    assert b.notif_date is None and b.system_status is None and b.description == "multi\nline text"
    c = rows["10003"]
    assert c.description is None and c.order_no == "n/a" and c.has_long_text is False
    v = {r.column: r.violations for r in I.length_violations(df, "notification").collect()}
    assert v["notif_type"] == 1 and v["notification"] == 0
    assert df.schema["required_end"].dataType.simpleString() == "date"


def test_bom_duplicate_headers(spark, files):
    ex = I.read_csv_export(spark, files["bom.csv"])
    assert ex.kind == "bom"
    r = {x.equipment: x for x in I.clean_export(ex, "b1").collect()}
    assert (r["EQ1"].equipment_desc, r["EQ1"].component_desc, r["EQ1"].item_text) == ("Pump A", "Seal kit", "first")
    assert str(r["EQ1"].quantity) == "2.500" and r["EQ2"].quantity is None
    assert r["EQ2"].item_text is None


def test_ingest_modes_and_batches(spark, files, tmp_path):
    root = str(tmp_path / "lake")
    with open(files["notif.csv"], "w") as f:
        f.write(NOTIF_CSV.replace("M3-TOO-LONG-TYPE", "M3"))
    paths = [files["notif.csv"], files["bom.csv"], files["other.csv"], files["readme.txt"]]
    out = {r.file: r for r in I.ingest_files(spark, paths, "B1", root, "append").collect()}
    assert out[files["notif.csv"]].status == "ok" and out[files["notif.csv"]].rows == 3
    assert out[files["other.csv"]].status == "skip"
    assert out[files["readme.txt"]].kind == "unsupported"
    I.ingest_files(spark, [files["notif.csv"]], "B2", root, "append").collect()
    notif = f"{root}/notifications"
    assert spark.read.parquet(notif).count() == 6     # same file twice: doubled
    I.ingest_files(spark, [files["notif.csv"]], "B3", root, "replace").collect()
    assert spark.read.parquet(notif).count() == 3
    assert spark.read.parquet(f"{root}/bom").count() == 2   # replace leaves other kinds
    I.ingest_files(spark, [files["notif.csv"]], "B4", root, "append").collect()
    assert I.delete_batch_files(spark, notif, "B3")
    left = spark.read.parquet(notif)
    assert [r.upload_batch for r in left.select("upload_batch").distinct().collect()] == ["B4"]
    summary = I.outcome_summary(I.ingest_files(spark, paths, "B5", root)).first()
    assert (summary.ok, summary.total) == (2, 4)
    assert os.path.isdir(f"{notif}/upload_batch=B5")


def test_replace_is_staged(spark, tmp_path):
    """A replace whose write fails leaves the old table readable."""
    from pyspark.sql import functions as F
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "B1")], "x int, upload_batch string")
    I.replace_table(spark, old, path, "a")
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).cast("int").alias("x"),
                                F.lit("B2").alias("upload_batch"))
    with pytest.raises(Exception):
        I.replace_table(spark, bad, path, "b")
    assert [r.x for r in spark.read.parquet(path).collect()] == [1]
    new = spark.createDataFrame([(2, "B3"), (3, "B3")], "x int, upload_batch string")
    I.replace_table(spark, new, path, "c")
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 3]
    left = os.listdir(tmp_path)
    assert "t" in left and not any(d.startswith("t.__old-") for d in left)


def test_parquet_exports(spark, tmp_path):
    """Typed Parquet exports: real date cells are kept, text numbers cleaned."""
    a = str(tmp_path / "wo1.parquet")
    b = str(tmp_path / "wo2.parquet")
    schema = "`Order Type` string, `Bas. start date` date, `Order` string, `TotalPlnndCosts` string"
    spark.createDataFrame([("PT02", dt.date(2001, 1, 2), " 77 ", "12.345")], schema).write.parquet(a)
    spark.createDataFrame([("PT03", None, "78", "n/a"), (None, None, None, None)], schema).write.parquet(b)
    root = str(tmp_path / "lake")
    out = {os.path.basename(r.file.rstrip("/")): r for r in
           I.ingest_files(spark, [a, b], "P1", root).collect()}
    assert sum(r.rows for r in out.values()) == 2
    rows = {r.order_no: r for r in spark.read.parquet(f"{root}/work_orders").collect()}
    assert rows["77"].bas_start_date == dt.date(2001, 1, 2) and str(rows["77"].total_plan_cost) == "12.35"
    assert rows["78"].total_plan_cost is None and rows["78"].order_type == "PT03"


def test_outcomes_of_odd_files(spark, tmp_path):
    """Blanks in names, header-only, empty, missing, corrupt and over-long files:
    each has its outcome under the path as given, and the good ones are loaded."""
    good = NOTIF_CSV.replace("M3-TOO-LONG-TYPE", "M3")
    bodies = {"sp ace%é.csv": good, "head.csv": good.split("\n")[0] + "\n", "empty.csv": "", "long.csv": NOTIF_CSV,
              "bad.parquet": "no parquet", "other.csv": UNKNOWN_CSV, "note.txt": "x"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    paths = [str(tmp_path / name) for name in [*bodies, "missing.csv"]]
    out = {os.path.basename(r.file): (r.status, r.kind, r.rows) for r in
           I.ingest_files(spark, paths, "B1", str(tmp_path / "lake")).collect()}
    assert out.pop("bad.parquet")[0] == "error"
    assert out == {"sp ace%é.csv": ("ok", "notification", 3), "head.csv": ("ok", "notification", 0),
                   "empty.csv": ("skip", "empty", 0), "long.csv": ("error", "notification", 0),
                   "other.csv": ("skip", "unknown", 0), "note.txt": ("skip", "unsupported", 0),
                   "missing.csv": ("error", "missing", 0)}
    assert spark.read.parquet(str(tmp_path / "lake" / "notifications")).count() == 3


def test_delete_all_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "B1"), (2, "B 2")], "x int, upload_batch string").write.partitionBy("upload_batch").parquet(path)
    assert I.delete_batch_files(spark, path, "B 2") and [r.x for r in spark.read.parquet(path).collect()] == [1]
    assert I.delete_batch_files(spark, path, "ALL") and not any(d.startswith("upload") for d in os.listdir(path))
    assert not I.delete_batch_files(spark, path, "ALL") and I.without_batch(spark.range(3), "ALL").count() == 0


def test_headers_of_any_shape(spark, tmp_path):
    """Line breaks inside a quoted header cell, a byte order mark, and a header
    beyond the bytes that are read for one."""
    many = ",".join(f"col {i} {'x' * 40}" for i in range(2500))
    bodies = {"break.csv": '"Notifictn type","Notification","a\nname, with a break"\nM1,1,z\nM2,2,"y\ny"\n',
              "bom.csv": "﻿Notifictn type,Notification\r\nM1,3\r\n", "wide.csv": f"Notifictn type,Notification,{many}\nM1,4\n",
              "open.csv": '"Notifictn type,Notification\nM1,5\n' + "x\n" * 50_000}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body, newline="")
    paths = [str(tmp_path / n) for n in bodies]
    for multi_line in (True, False):
        root = str(tmp_path / f"lake-{multi_line}")
        out = {os.path.basename(r.file): (r.status, r.kind, r.rows) for r in
               I.ingest_files(spark, paths, "B1", root, multi_line=multi_line).collect()}
        assert out == {"break.csv": ("ok", "notification", 2), "bom.csv": ("ok", "notification", 1),
                       "wide.csv": ("error", "header", 0), "open.csv": ("error", "header", 0)}
        assert sorted(r.notification for r in spark.read.parquet(f"{root}/notifications").collect()) == ["1", "2", "3"]


def test_head_reads_are_bounded(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_bytes(b"a,b\n" + b"1,2\n" * 3_000_000)
    assert len(I.file_head(spark, str(path))) == I.HEAD_BYTES + 1
    assert I.read_header(spark, str(path)) == ["a", "b"] and I.file_head(spark, str(tmp_path / "none.csv")) is None


def test_a_spoiled_data_page_costs_one_file(spark, tmp_path):
    """A Parquet file with a good footer and a broken page beside good files of
    the same layout."""
    schema = "`Order Type` string, `Bas. start date` date, `Order` string"
    paths = []
    for k in range(5):
        folder = str(tmp_path / f"p{k}")
        spark.createDataFrame([(f"PT{i % 9}", dt.date(2001, 1, 2), f"{k}-{i}") for i in range(2000)], schema).coalesce(1).write.parquet(folder)
        name = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
        os.rename(f"{folder}/{name}", str(tmp_path / f"wo{k}.parquet"))
        paths.append(str(tmp_path / f"wo{k}.parquet"))
    with open(paths[3], "r+b") as f:
        f.seek(4)
        f.write(b"\xff" * 600)
    root = str(tmp_path / "lake")
    out = {r.file: (r.status, r.rows) for r in I.ingest_files(spark, paths, "B1", root).collect()}
    assert out == {p: ("error", 0) if p == paths[3] else ("ok", 2000) for p in paths}
    table = spark.read.parquet(f"{root}/work_orders")
    assert table.count() == 8000 and table.where("order_no like '3-%'").count() == 0


def test_exports_are_evaluated_once(spark):
    """Counts are observed while the rows are written: each row passes once."""
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = spark.range(500).select(F.lit("M1").alias("c0"), F.col("id").cast("string").alias("c1")).mapInArrow(count, "c0 string, c1 string")
    tables, outcomes = I.ingest_exports([I.Export("e", raw, ("Notifictn type", "Notification"))], "B1")
    assert [tuple(r) for r in outcomes.collect()] == [("e", "ok", "notification", 500)] and seen.value == 500
    assert tables["notification"].count() == 500 and seen.value == 500
    I.release(tables)
