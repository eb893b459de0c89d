"""Fixture views: the maintenance tables derived from the supplied tables.

The supplied test data has no maintenance tables, so each one is a pure
projection of a base table (no joins, no shuffles): column pruning and
filters on derived columns reach the parquet scan.  The same derivation is
written once more as SQL text for the independent DuckDB oracle
(``upkeep.plans.views_sql``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.sources.tables import base

# Fixed value: the reporting date pinned for every registered query.
AS_OF = dt.date(2001, 6, 30)


def _s(c: Column) -> Column:
    return c.cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _plus_days(d: Column, n: Column) -> Column:
    return F.date_add(d, n.cast("int"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = F.col("o_orderdate").cast("date")
    st = F.col("o_orderstatus")
    prio = F.substring(F.col("o_orderpriority"), 1, 1)
    return o.select(
        k.alias("id"),
        _cat("M", _s(k % 4 + 1)).alias("notif_type"),
        d.alias("notif_date"),
        _s(F.lit(10000000) + k).alias("notification"),
        F.when(k % 41 == 0, F.lit(None).cast("string"))
         .when(st == "O", "OSNO").when(st == "P", "NOPR OSTS").otherwise("NOCO")
         .alias("system_status"),
        d.alias("req_start"),
        F.when(k % 53 == 0, F.lit(None).cast("date"))
         .otherwise(_plus_days(d, k % 120)).alias("required_end"),
        F.when(c % 19 == 0, "").otherwise(_cat("WC", _s(c % 17))).alias("main_workctr"),
        _cat("PG", _s(c % 5)).alias("planner_group"),
        _cat("request ", _s(k), " ", F.repeat(F.lit("x"), (k % 100).cast("int")))
         .alias("description"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "")
         .otherwise(_s(k)).alias("order_no"),
        _cat("RU", _s(c % 7)).alias("location"),
        _cat("FL", _s(c % 50)).alias("functional_loc"),
        _cat("MP", _s(c % 3)).alias("maint_plant"),
        (k % 6 == 0).alias("has_long_text"),
        F.when(c % 23 == 0, "").otherwise(_cat("EQ", _s(c))).alias("equipment"),
        F.when(prio == "1", "H").when(prio == "2", "I").when(prio == "3", "M")
         .when(prio == "5", "L").alias("criticality"),
        _cat("B", _s(k % 3)).alias("upload_batch"),
        F.col("o_orderdate").alias("uploaded_at"),
    )


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base(spark, sf_dir, "lineitem")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    ln = F.col("l_linenumber")
    ship = F.col("l_shipdate").cast("date")
    ls, rf = F.col("l_linestatus"), F.col("l_returnflag")
    price = F.col("l_extendedprice").cast(T.DecimalType(18, 2))
    lt4 = ln % 4
    return li.select(
        _cat(_s(ok), "-", _s(pk), "-", _s(sk), "-", _s(ln)).alias("id"),
        _cat("P", _s(sk % 4)).alias("plant"),
        ship.alias("created_on"),
        _plus_days(ship, ln).alias("bas_start_date"),
        F.when(pk % 29 == 0, F.lit(None).cast("date"))
         .otherwise(_plus_days(ship, pk % 250)).alias("basic_fin_date"),
        _s(ok).alias("order_no"),
        _cat("job ", _s(pk), " ", F.repeat(F.lit("y"), (pk % 100).cast("int")))
         .alias("description"),
        _cat("RU", _s(sk % 7)).alias("location"),
        _cat("FL", _s(pk % 50)).alias("functional_loc"),
        _cat("EQ", _s(pk % 1500)).alias("equipment"),
        F.when(lt4 == 0, "H").when(lt4 == 1, "M").when(lt4 == 2, "L").alias("criticality"),
        F.when(pk % 37 == 0, F.lit(None).cast("string"))
         .when((ls == "O") & (rf == "A"), "CRTD MANC")
         .when((ls == "O") & (rf == "N"), "REL PRC")
         .when(ls == "O", "CRTD REL")
         .when(rf == "A", "TECO REL")
         .when(rf == "N", "CLSD")
         .otherwise("teco").alias("system_status"),
        _cat("PG", _s(sk % 5)).alias("planner_group"),
        price.alias("total_plan_cost"),
        F.when(pk % 11 == 0, F.lit(None).cast(T.DecimalType(18, 2)))
         .otherwise((price + (pk % 200 - 100).cast(T.DecimalType(18, 2)))
                    .cast(T.DecimalType(18, 2))).alias("total_act_cost"),
        F.when(pk % 13 == 0, "").otherwise(_cat("WC", _s(sk % 17))).alias("main_workctr"),
        F.when(pk % 3 == 0, F.lit(None).cast("string")).when(pk % 3 == 1, "")
         .otherwise(_cat("PO", _s(pk))).alias("po_number"),
        F.when((ls == "F") & (pk % 7 != 0), _plus_days(ship, pk % 60)).alias("actual_finish"),
        F.when(pk % 4 != 0, _plus_days(ship, pk % 20)).alias("actual_release"),
        F.when(pk % 31 == 0, F.lit(None).cast("string"))
         .otherwise(F.when(lt4 == 0, "PT02").when(lt4 == 1, "PT03").when(lt4 == 2, "PT05")
                    .otherwise("PT08")).alias("order_type"),
        _s(ln % 3 + 1).alias("priority"),
        F.when(sk % 2 == 0, _cat("PR", _s(sk))).alias("purc_req"),
        _cat("B", _s(ok % 3)).alias("upload_batch"),
        F.col("l_shipdate").alias("uploaded_at"),
    )


def bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(
        pk.alias("id"),
        _cat("EQ", _s(pk % 300)).alias("equipment"),
        F.col("p_name").alias("equipment_desc"),
        _cat("MAT", _s(pk)).alias("component"),
        F.col("p_type").alias("component_desc"),
        F.col("p_size").cast(T.DecimalType(18, 3)).alias("quantity"),
        F.lit("2001-06-01 00:00:00").cast("timestamp_ntz").alias("uploaded_at"),
    )


def cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"),
        _cat("PRJ", _s(F.col("l_suppkey") % 20)).alias("project_definition"),
        F.col("l_shipdate").cast("date").alias("posting_date"),
        _s(F.col("l_orderkey")).alias("order_no"),
        F.col("l_extendedprice").cast(T.DecimalType(18, 2)).alias("val_in_rep_cur"),
        F.col("l_shipdate").alias("uploaded_at"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base(spark, sf_dir, "documents")
    k = F.col("doc_id")
    m3 = k % 3
    return d.select(
        k.alias("id"),
        F.when(m3 == 0, "daily").when(m3 == 1, "weekly").otherwise("monthly").alias("type"),
        F.col("text").alias("content"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (k % 200).cast("int"))
         .cast("timestamp_ntz").alias("created_at"),
    )


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memo per document; it cites three reports by id (some ids past the
    end of the archive, as for deleted reports)."""
    d = base(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("id"),
        _cat("Memo ", _s(k)).alias("title"),
        F.array(k.cast("int"), (k + 7).cast("int"), (k + 13).cast("int")).alias("source_report_ids"),
        F.col("text").alias("content"),
        F.date_add(F.lit(dt.date(2024, 3, 1)), (k % 97).cast("int"))
         .cast("timestamp_ntz").alias("created_at"),
    )


def asset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    m9, m4, m6 = k % 9, k % 4, k % 6
    m3 = k % 3
    return e.select(
        k.alias("id"),
        F.col("ts").cast("date").alias("period"),
        _cat("RU", _s(u % 7)).alias("ru"),
        _cat("TAG", _s(u)).alias("tag"),
        F.col("event_type").alias("kind"),
        F.when(m9 == 0, "Open").when(m9 == 1, "closed").when(m9 == 2, "DONE")
         .when(m9 == 3, F.lit(None).cast("string")).when(m9 == 4, "normal").when(m9 == 5, "OK")
         .when(m9 == 6, "Standby").when(m9 == 7, "Aktif").otherwise("valid").alias("status_a"),
        F.when(m4 == 0, "valid").when(m4 == 1, "expired").when(m4 == 2, F.lit(None).cast("string"))
         .otherwise("ACTIVE").alias("status_b"),
        F.when(m6 == 0, "Red").when(m6 == 1, "yellow").when(m6 == 2, "orange").when(m6 == 3, "green")
         .when(m6 == 4, F.lit(None).cast("string")).otherwise("Merah").alias("colour"),
        F.when(m4 == 0, "  ").when(m4 == 1, F.lit(None).cast("string"))
         .otherwise(_cat("issue ", _s(k))).alias("issue"),
        F.when(k % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("actual"),
        (k % 100).cast("double").alias("target"),
        F.when(m3 == 0, F.lit(None).cast("string")).when(m3 == 1, " ")
         .otherwise("2024-01-15").alias("removed_on"),
    )


# Monitoring tables: each is a projection of asset_status (target name <- source column).
MONITORING = {
    "bad_actor_monitoring": [("id", "id"), ("ru", "ru"), ("tag_number", "tag"), ("status", "status_a"),
                             ("problem", "issue"), ("action_plan", "kind"), ("progress", "status_b"),
                             ("target_date", "period"), ("periode", "period")],
    "icu_monitoring": [("id", "id"), ("ru", "ru"), ("tag_no", "tag"), ("icu_status", "status_a"),
                       ("issue", "issue"), ("mitigation", "kind"), ("progress", "status_b"),
                       ("target_closed", "period"), ("report_date", "period")],
    "zero_clamp": [("id", "id"), ("ru", "ru"), ("area", "kind"), ("unit", "status_b"),
                   ("tag_no_ln", "tag"), ("type_damage", "issue"), ("tanggal_dipasang", "period"),
                   ("tanggal_dilepas", "removed_on"), ("status", "status_a")],
    "paf": [("id", "id"), ("ru", "ru"), ("type", "kind"), ("target_realisasi", "target"),
            ("value", "actual"), ("color", "colour"), ("month_update", "period")],
    "power_stream": [("id", "id"), ("refinery_unit", "ru"), ("type_equipment", "kind"),
                     ("equipment", "tag"), ("status_operation", "status_a"), ("remark", "issue"),
                     ("date_update", "period")],
    "critical_eqp_utl": [("id", "id"), ("refinery_unit", "ru"), ("type_equipment", "kind"),
                         ("highlight_issue", "issue"), ("corrective_action", "status_b"),
                         ("target_corrective", "period"), ("month_update", "period")],
    "monitoring_operasi": [("id", "id"), ("refinery_unit", "ru"), ("unit_proses", "kind"),
                           ("actual", "actual"), ("target_sts", "target"),
                           ("limitasi_alert_process", "issue"), ("month_update", "period")],
    "readiness_jetty": [("id", "id"), ("refinery_unit", "ru"), ("tag_no", "tag"),
                        ("status_operation", "status_a"), ("status_tuks", "status_b"),
                        ("status_ijin_ops", "colour"), ("month_update", "period")],
    "readiness_tank": [("id", "id"), ("refinery_unit", "ru"), ("tag_number", "tag"),
                       ("status_operational", "status_a"), ("status_coi", "status_b"),
                       ("status_atg", "colour"), ("month_update", "period")],
    "readiness_spm": [("id", "id"), ("refinery_unit", "ru"), ("tag_no", "tag"),
                      ("status_operation", "status_a"), ("status_laik_operasi", "status_b"),
                      ("month_update", "period")],
    "atg_monitoring": [("id", "id"), ("refinery_unit", "ru"), ("tag_no_tangki", "tag"),
                       ("tag_no_atg", "kind"), ("status_atg", "status_a"),
                       ("status_interkoneksi_atg", "status_b"), ("month_update", "period")],
}


def monitoring(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    a = asset_status(spark, sf_dir)
    return a.select(*[F.col(src).alias(dst) for dst, src in MONITORING[name]])


VIEWS = {
    "notifications": notifications,
    "work_orders": work_orders,
    "bom": bom,
    "cost_lines": cost_lines,
    "reports": reports,
    "memos": memos,
    "asset_status": asset_status,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in VIEWS:
        return VIEWS[name](spark, sf_dir)
    return monitoring(spark, sf_dir, name)
