"""Landing-folder streaming ingest: every arriving file lands once."""

import os

import pytest

from upkeep.streaming.landing import start_landing_ingest

HEAD = "Notifictn type,Notif.date,Notification,Order"


def test_landing_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text(HEAD + "\nM1,2001-01-01,1,100\nM2,2001-01-02,2,\n")
    root = str(tmp_path / "lake")
    ckpt = str(tmp_path / "ckpt")
    q = start_landing_ingest(spark, str(landing), HEAD.split(","), root, ckpt, "s")
    q.awaitTermination(120)
    (landing / "b.csv").write_text(HEAD + "\nM3,2001-01-03,3,300\n")
    q = start_landing_ingest(spark, str(landing), HEAD.split(","), root, ckpt, "s")
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(root, "notifications"))
    assert sorted(r.notification for r in out.collect()) == ["1", "2", "3"]
    assert out.select("upload_batch").distinct().count() == 2


def test_replayed_epoch_is_idempotent(spark, tmp_path):
    from upkeep.streaming.landing import ingest_batch
    from upkeep.sources.ingest import positional
    headers = tuple(HEAD.split(","))
    df = positional(spark.createDataFrame([("M1", "2001-01-01", "9", "1")], "a string, b string, c string, d string"))
    target = str(tmp_path / "t")
    for _ in range(2):                      # the same epoch delivered twice after a failure
        ingest_batch(df, 7, headers, "notification", target, "s")
    out = spark.read.parquet(target)
    assert out.count() == 1 and out.first().upload_batch == "s-7"


def test_restart_after_archiving_keeps_rows(spark, tmp_path):
    landing, root, ckpt = tmp_path / "landing", str(tmp_path / "lake"), str(tmp_path / "ckpt")
    landing.mkdir()
    (landing / "a.csv").write_text(HEAD + "\nM1,2001-01-01,1,100\n")
    start_landing_ingest(spark, str(landing), HEAD.split(","), root, ckpt, "s").awaitTermination(120)
    (landing / "a.csv").rename(tmp_path / "archived.csv")
    (landing / "b.csv").write_text(HEAD + "\nM1,2001-01-02,2,100\n")
    start_landing_ingest(spark, str(landing), HEAD.split(","), root, ckpt, "s").awaitTermination(120)
    assert sorted(r.notification for r in spark.read.parquet(f"{root}/notifications").collect()) == ["1", "2"]


def test_two_streams_into_one_table(spark, tmp_path):
    root = str(tmp_path / "lake")
    for name in ("east", "west"):
        landing = tmp_path / name
        landing.mkdir()
        (landing / "a.csv").write_text(HEAD + f"\nM1,2001-01-01,{name},100\n")
        start_landing_ingest(spark, str(landing), HEAD.split(","), root, str(tmp_path / f"c-{name}"),
                             name).awaitTermination(120)
    assert sorted(r.notification for r in spark.read.parquet(f"{root}/notifications").collect()) == ["east", "west"]


def test_checkpoint_and_name_are_required(spark, tmp_path):
    with pytest.raises(ValueError):
        start_landing_ingest(spark, str(tmp_path), HEAD.split(","), str(tmp_path), "", "s")
