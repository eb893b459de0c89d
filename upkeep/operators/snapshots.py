"""Snapshot monitoring sections: latest / previous period of a status table.

The period is found with an uncorrelated scalar subquery (``DataFrame.scalar``):
Spark runs the one-column MAX first and filters with its value, so no
window over the whole table and no driver round-trip is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions.status import lower_or_empty, trimmed_or_empty

# Status words that mean "no action needed", per section.
BAD_ACTOR_CLOSED = ["closed", "complete", "selesai", "done"]
ICU_CLOSED = ["closed", "resolved", "selesai"]
PAF_ALERT_COLOURS = ["red", "yellow", "orange", "merah", "kuning"]
POWER_OK = ["normal", "standby", "ok", "siaga"]
JETTY_OPERATION_OK = ["normal", "siap", "ok", "ready"]
JETTY_TUKS_OK = ["valid", "ok", "aktif"]
TANK_OK = ["normal", "ok", "siap"]
SPM_OK = ["normal", "siap", "ok", "ready"]
ATG_OK = ["ok", "normal", "aktif"]
ATG_LINK_OK = ["aktif", "active", "ok"]


def latest_value(df: DataFrame, period_col: str) -> Column:
    return df.select(F.max(period_col)).scalar()


def previous_value(df: DataFrame, period_col: str) -> Column:
    """The second of the distinct periods, from one aggregate; NULL if there is
    only one.  A period is a date or a label of one upload, so there are few."""
    return df.select(F.get(F.sort_array(F.collect_set(period_col), asc=False), F.lit(1))).scalar()


def snapshot(df: DataFrame, period_col: str, which: str = "latest") -> DataFrame:
    """Rows of the latest (or the one before) period."""
    if which == "latest":
        v = latest_value(df, period_col)
    elif which == "previous":
        v = previous_value(df, period_col)
    else:
        raise ValueError(f"unknown snapshot {which!r}")
    return df.filter(F.col(period_col) == v)


def not_in(c: str, words) -> Column:
    return ~lower_or_empty(c).isin(words)


def is_in(c: str, words) -> Column:
    return lower_or_empty(c).isin(words)


@dataclass(frozen=True)
class Section:
    table: str
    period: str | None          # None: no snapshot filter
    which: str                  # latest | previous
    columns: tuple[str, ...]
    order: tuple[str, ...]      # ascending, NULLs last; the row id is appended
    limit: int | None
    predicate: object = None    # callable () -> Column, or None

    def build(self, df: DataFrame) -> DataFrame:
        f = snapshot(df, self.period, self.which) if self.period else df
        if self.predicate is not None:
            f = f.filter(self.predicate())
        out = f.orderBy(*[F.asc_nulls_last(c) for c in self.order], F.asc("id")).select("id", *self.columns)
        return out.limit(self.limit) if self.limit is not None else out


# The columns of the sections.
BA_COLS = ("ru", "tag_number", "status", "problem", "action_plan", "progress", "target_date", "periode")


def _sections() -> dict[str, dict[str, Section]]:
    ba = lambda lim: Section("bad_actor_monitoring", "periode", "latest", BA_COLS, ("ru", "tag_number"), lim,
                             lambda: not_in("status", BAD_ACTOR_CLOSED))
    ba_prev = Section("bad_actor_monitoring", "periode", "previous", ("tag_number", "status", "progress"),
                      ("tag_number",), 30)
    icu_pred = lambda: not_in("icu_status", ICU_CLOSED)
    paf_pred = lambda: is_in("color", PAF_ALERT_COLOURS)
    paf_w = ("ru", "type", "value", "color", "month_update")
    power = lambda lim: Section("power_stream", "date_update", "latest",
                                ("refinery_unit", "type_equipment", "equipment", "status_operation", "remark",
                                 "date_update"), ("refinery_unit",), lim,
                                lambda: not_in("status_operation", POWER_OK))
    tank = lambda cols: Section("readiness_tank", "month_update", "latest", cols,
                                ("refinery_unit", "tag_number"), 15,
                                lambda: not_in("status_operational", TANK_OK))
    spm = Section("readiness_spm", "month_update", "latest",
                  ("refinery_unit", "tag_no", "status_operation", "status_laik_operasi", "month_update"),
                  ("refinery_unit", "tag_no"), 15, lambda: not_in("status_operation", SPM_OK))
    atg = Section("atg_monitoring", "month_update", "latest",
                  ("refinery_unit", "tag_no_tangki", "tag_no_atg", "status_atg", "status_interkoneksi_atg",
                   "month_update"), ("refinery_unit",), 20,
                  lambda: not_in("status_atg", ATG_OK) | not_in("status_interkoneksi_atg", ATG_LINK_OK))
    jetty_m = Section("readiness_jetty", "month_update", "latest",
                      ("refinery_unit", "tag_no", "status_operation", "status_tuks", "month_update"),
                      ("refinery_unit", "tag_no"), 15, lambda: not_in("status_operation", JETTY_OPERATION_OK))
    return {
        "daily": {
            "bad_actor": ba(20),
            "icu": Section("icu_monitoring", "report_date", "latest",
                           ("ru", "tag_no", "icu_status", "issue", "mitigation", "progress", "target_closed",
                            "report_date"), ("ru", "tag_no"), 20, icu_pred),
            "zero_clamp": Section("zero_clamp", None, "latest",
                                  ("ru", "area", "unit", "tag_no_ln", "type_damage", "tanggal_dipasang", "status"),
                                  ("tanggal_dipasang",), 15,
                                  lambda: F.col("tanggal_dilepas").isNull()
                                  | (trimmed_or_empty("tanggal_dilepas") == "")),
            "paf": Section("paf", "month_update", "latest",
                           ("ru", "type", "target_realisasi", "value", "color", "month_update"), ("ru", "type"),
                           20, paf_pred),
            "power_utility": power(15),
            "critical_utl": Section("critical_eqp_utl", "month_update", "latest",
                                    ("refinery_unit", "type_equipment", "highlight_issue", "corrective_action",
                                     "target_corrective"), ("refinery_unit",), 10,
                                    lambda: trimmed_or_empty("highlight_issue") != ""),
            "monitoring_operasi": Section("monitoring_operasi", "month_update", "latest",
                                          ("refinery_unit", "unit_proses", "actual", "target_sts",
                                           "limitasi_alert_process", "month_update"), ("refinery_unit",), 15,
                                          lambda: (trimmed_or_empty("limitasi_alert_process") != "")
                                          | (F.col("actual").isNotNull() & F.col("target_sts").isNotNull()
                                             & (F.col("actual") < F.col("target_sts")))),
        },
        "weekly": {
            "bad_actor_current": ba(30),
            "bad_actor_prev": ba_prev,
            "icu_current": Section("icu_monitoring", "report_date", "latest",
                                   ("ru", "tag_no", "icu_status", "issue", "progress", "target_closed",
                                    "report_date"), ("ru", "tag_no"), 25, icu_pred),
            "paf_current": Section("paf", "month_update", "latest", paf_w, ("ru", "type"), 25, paf_pred),
            "paf_prev": Section("paf", "month_update", "previous", paf_w, ("ru", "type"), 25),
            "power_utility": power(20),
            "readiness_jetty": Section("readiness_jetty", "month_update", "latest",
                                       ("refinery_unit", "tag_no", "status_operation", "status_tuks",
                                        "status_ijin_ops", "month_update"), ("refinery_unit", "tag_no"), 15,
                                       lambda: not_in("status_operation", JETTY_OPERATION_OK)
                                       | not_in("status_tuks", JETTY_TUKS_OK)),
            "readiness_tank": tank(("refinery_unit", "tag_number", "status_operational", "status_coi",
                                    "status_atg", "month_update")),
            "readiness_spm": spm,
            "atg": atg,
        },
        "monthly": {
            "bad_actor_current": ba(30),
            "bad_actor_prev": ba_prev,
            "icu_current": Section("icu_monitoring", "report_date", "latest",
                                   ("ru", "tag_no", "icu_status", "issue", "progress", "report_date"), (), 25,
                                   icu_pred),
            "paf_current": Section("paf", "month_update", "latest", paf_w, ("ru", "type"), 25, paf_pred),
            "paf_prev": Section("paf", "month_update", "previous", paf_w, ("ru", "type"), 25),
            "readiness_jetty": jetty_m,
            "readiness_tank": tank(("refinery_unit", "tag_number", "status_operational", "status_coi",
                                    "month_update")),
            "readiness_spm": spm,
            "atg": atg,
        },
    }


SECTIONS = _sections()


def gather(tables: dict[str, DataFrame], cadence: str, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    """All sections of a daily/weekly/monthly pack as lazy DataFrames.

    A section whose source table is missing is there without rows, so that a
    missing upstream table gives an empty section and never fails the pack.
    """
    spark = spark or SparkSession.active()
    out = {}
    for name, sec in SECTIONS[cadence].items():
        if sec.table in tables:
            out[name] = sec.build(tables[sec.table])
        else:
            out[name] = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ("id", *sec.columns)))
    return out


def bad_actor_trend(current: DataFrame, previous: DataFrame, tag_col: str = "tag_number") -> DataFrame:
    """Tags present in both periods ("recurring") and only in the current one ("new")."""
    cur = current.select(tag_col).filter(F.col(tag_col).isNotNull()).distinct()
    prev = previous.select(tag_col).filter(F.col(tag_col).isNotNull()).distinct()
    rec = cur.join(prev, tag_col, "left_semi").withColumn("trend", F.lit("recurring"))
    new = cur.join(prev, tag_col, "left_anti").withColumn("trend", F.lit("new"))
    return rec.unionByName(new).orderBy("trend", tag_col)
