"""The sections and worklists of the packs, written out: table, period, sort
columns, limit and shown columns of each (fixed values)."""

from upkeep.operators import snapshots as S
from upkeep.operators import worklists as W

SECTIONS = {
    ("daily", "bad_actor"): (
        "bad_actor_monitoring", 'periode', "latest", "ru tag_number", 20,
        "ru tag_number status problem action_plan progress target_date periode"),
    ("daily", "icu"): (
        "icu_monitoring", 'report_date', "latest", "ru tag_no", 20,
        "ru tag_no icu_status issue mitigation progress target_closed report_date"),
    ("daily", "zero_clamp"): (
        "zero_clamp", None, "latest", "tanggal_dipasang", 15,
        "ru area unit tag_no_ln type_damage tanggal_dipasang status"),
    ("daily", "paf"): (
        "paf", 'month_update', "latest", "ru type", 20,
        "ru type target_realisasi value color month_update"),
    ("daily", "power_utility"): (
        "power_stream", 'date_update', "latest", "refinery_unit", 15,
        "refinery_unit type_equipment equipment status_operation remark date_update"),
    ("daily", "critical_utl"): (
        "critical_eqp_utl", 'month_update', "latest", "refinery_unit", 10,
        "refinery_unit type_equipment highlight_issue corrective_action target_corrective"),
    ("daily", "monitoring_operasi"): (
        "monitoring_operasi", 'month_update', "latest", "refinery_unit", 15,
        "refinery_unit unit_proses actual target_sts limitasi_alert_process month_update"),
    ("weekly", "bad_actor_current"): (
        "bad_actor_monitoring", 'periode', "latest", "ru tag_number", 30,
        "ru tag_number status problem action_plan progress target_date periode"),
    ("weekly", "bad_actor_prev"): (
        "bad_actor_monitoring", 'periode', "previous", "tag_number", 30,
        "tag_number status progress"),
    ("weekly", "icu_current"): (
        "icu_monitoring", 'report_date', "latest", "ru tag_no", 25,
        "ru tag_no icu_status issue progress target_closed report_date"),
    ("weekly", "paf_current"): (
        "paf", 'month_update', "latest", "ru type", 25,
        "ru type value color month_update"),
    ("weekly", "paf_prev"): (
        "paf", 'month_update', "previous", "ru type", 25,
        "ru type value color month_update"),
    ("weekly", "power_utility"): (
        "power_stream", 'date_update', "latest", "refinery_unit", 20,
        "refinery_unit type_equipment equipment status_operation remark date_update"),
    ("weekly", "readiness_jetty"): (
        "readiness_jetty", 'month_update', "latest", "refinery_unit tag_no", 15,
        "refinery_unit tag_no status_operation status_tuks status_ijin_ops month_update"),
    ("weekly", "readiness_tank"): (
        "readiness_tank", 'month_update', "latest", "refinery_unit tag_number", 15,
        "refinery_unit tag_number status_operational status_coi status_atg month_update"),
    ("weekly", "readiness_spm"): (
        "readiness_spm", 'month_update', "latest", "refinery_unit tag_no", 15,
        "refinery_unit tag_no status_operation status_laik_operasi month_update"),
    ("weekly", "atg"): (
        "atg_monitoring", 'month_update', "latest", "refinery_unit", 20,
        "refinery_unit tag_no_tangki tag_no_atg status_atg status_interkoneksi_atg month_update"),
    ("monthly", "bad_actor_current"): (
        "bad_actor_monitoring", 'periode', "latest", "ru tag_number", 30,
        "ru tag_number status problem action_plan progress target_date periode"),
    ("monthly", "bad_actor_prev"): (
        "bad_actor_monitoring", 'periode', "previous", "tag_number", 30,
        "tag_number status progress"),
    ("monthly", "icu_current"): (
        "icu_monitoring", 'report_date', "latest", "", 25,
        "ru tag_no icu_status issue progress report_date"),
    ("monthly", "paf_current"): (
        "paf", 'month_update', "latest", "ru type", 25,
        "ru type value color month_update"),
    ("monthly", "paf_prev"): (
        "paf", 'month_update', "previous", "ru type", 25,
        "ru type value color month_update"),
    ("monthly", "readiness_jetty"): (
        "readiness_jetty", 'month_update', "latest", "refinery_unit tag_no", 15,
        "refinery_unit tag_no status_operation status_tuks month_update"),
    ("monthly", "readiness_tank"): (
        "readiness_tank", 'month_update', "latest", "refinery_unit tag_number", 15,
        "refinery_unit tag_number status_operational status_coi month_update"),
    ("monthly", "readiness_spm"): (
        "readiness_spm", 'month_update', "latest", "refinery_unit tag_no", 15,
        "refinery_unit tag_no status_operation status_laik_operasi month_update"),
    ("monthly", "atg"): (
        "atg_monitoring", 'month_update', "latest", "refinery_unit", 20,
        "refinery_unit tag_no_tangki tag_no_atg status_atg status_interkoneksi_atg month_update"),
}

WORKLISTS = {
    "backlog_notifications": (
        "notifications", "required_end", 50,
        "notif_type notification system_status req_start required_end main_workctr description equipment functional_loc criticality location"),
    "overdue_notifications": (
        "notifications", "required_end", 30,
        "notif_type notification system_status req_start required_end description equipment criticality location"),
    "stagnant_wo": (
        "work_orders", "basic_fin_date", 50,
        "order_no order_type system_status bas_start_date basic_fin_date description equipment functional_loc criticality location main_workctr actual_release actual_finish"),
    "overdue_wo": (
        "work_orders", "basic_fin_date", 30,
        "order_no order_type system_status basic_fin_date description equipment criticality location main_workctr"),
    "pending_release_wo": (
        "work_orders", "bas_start_date", 20,
        "order_no order_type system_status bas_start_date basic_fin_date description equipment criticality location main_workctr"),
}


def test_sections():
    got = {(cadence, name): (x.table, x.period, x.which, " ".join(x.order), x.limit, " ".join(x.columns))
           for cadence, sections in S.SECTIONS.items() for name, x in sections.items()}
    assert got == SECTIONS


def test_worklists(spark):
    got = {name: (table, x.order_col, x.limit, " ".join(x.columns))
           for table, lists in W.control_tower_lists().items() for name, x in lists.items()}
    assert got == WORKLISTS
