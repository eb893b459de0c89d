"""Registered snapshot sections (weekly variants where the section exists in
several packs) and the bad-actor trend."""

from __future__ import annotations

from upkeep.operators import snapshots as S
from upkeep.plans.registry import register, views


def _among(column: str, words) -> str:
    """Whether the lower-case text of a column is one of some words; NULL counts as blank."""
    return f"list_contains({list(words)}, lower(coalesce({column}, '')))"


def _aged(table: str, period: str | None) -> str:
    """The table with the age of each row's period: 1 the latest, 2 the one before."""
    age = f"CASE WHEN {period} IS NOT NULL THEN dense_rank() OVER (ORDER BY {period} DESC NULLS LAST) END" if period else "1"
    return f"(SELECT *, {age} AS age FROM {table})"


def _sql(sec: S.Section, where: str) -> str:
    order = ", ".join([f"{c} NULLS LAST" for c in sec.order] + ["id"])
    lim = f" LIMIT {sec.limit}" if sec.limit is not None else ""
    return (f"SELECT id, {', '.join(sec.columns)} FROM {_aged(sec.table, sec.period)} "
            f"WHERE age = {2 if sec.which == 'previous' else 1} AND ({where or 'true'}) ORDER BY {order}{lim}")


WHERE = {
    "bad_actor_monitoring": f"NOT {_among('status', S.BAD_ACTOR_CLOSED)}",
    "icu_monitoring": f"NOT {_among('icu_status', S.ICU_CLOSED)}",
    "paf": _among("color", S.PAF_ALERT_COLOURS),
    "power_stream": f"NOT {_among('status_operation', S.POWER_OK)}",
    "critical_eqp_utl": "length(trim(highlight_issue)) > 0",
    "monitoring_operasi": "length(trim(limitasi_alert_process)) > 0 OR actual < target_sts",
    "zero_clamp": "coalesce(length(trim(tanggal_dilepas)), 0) = 0",
    "readiness_tank": f"NOT {_among('status_operational', S.TANK_OK)}",
    "readiness_spm": f"NOT {_among('status_operation', S.SPM_OK)}",
    "atg_monitoring": f"NOT ({_among('status_atg', S.ATG_OK)} AND {_among('status_interkoneksi_atg', S.ATG_LINK_OK)})",
}
JETTY_MONTHLY = f"NOT {_among('status_operation', S.JETTY_OPERATION_OK)}"
JETTY_WEEKLY = f"{JETTY_MONTHLY} OR NOT {_among('status_tuks', S.JETTY_TUKS_OK)}"

# key -> (cadence, section name, where text)
KEYS = {
    "snap_bad_actor": ("weekly", "bad_actor_current", WHERE["bad_actor_monitoring"]),
    "snap_bad_actor_prev": ("weekly", "bad_actor_prev", ""),
    "snap_icu": ("weekly", "icu_current", WHERE["icu_monitoring"]),
    "snap_zero_clamp": ("daily", "zero_clamp", WHERE["zero_clamp"]),
    "snap_paf": ("weekly", "paf_current", WHERE["paf"]),
    "snap_paf_prev": ("weekly", "paf_prev", ""),
    "snap_operations": ("daily", "monitoring_operasi", WHERE["monitoring_operasi"]),
    "snap_power": ("weekly", "power_utility", WHERE["power_stream"]),
    "snap_critical_utility": ("daily", "critical_utl", WHERE["critical_eqp_utl"]),
    "snap_jetty_weekly": ("weekly", "readiness_jetty", JETTY_WEEKLY),
    "snap_jetty_monthly": ("monthly", "readiness_jetty", JETTY_MONTHLY),
    "snap_tank": ("weekly", "readiness_tank", WHERE["readiness_tank"]),
    "snap_spm": ("weekly", "readiness_spm", WHERE["readiness_spm"]),
    "snap_tank_gauge": ("weekly", "atg", WHERE["atg_monitoring"]),
    "snap_icu_monthly": ("monthly", "icu_current", WHERE["icu_monitoring"]),
    "snap_bad_actor_daily": ("daily", "bad_actor", WHERE["bad_actor_monitoring"]),
}


def _reg(key, cadence, name, where):
    sec = S.SECTIONS[cadence][name]

    @register(key, _sql(sec, where))
    def q(spark, sf):
        (t,) = views(spark, sf, sec.table)
        return sec.build(t)
    return q


for _k, (_c, _n, _w) in KEYS.items():
    _reg(_k, _c, _n, _w)


@register("bad_actor_trend", f"""
SELECT tag_number, if(bool_or(age = 2), 'recurring', 'new') AS trend
FROM {_aged("bad_actor_monitoring", "periode")}
WHERE tag_number IS NOT NULL AND age <= 2
GROUP BY tag_number HAVING bool_or(age = 1 AND {WHERE['bad_actor_monitoring']})""")
def q_bad_actor_trend(spark, sf):
    (t,) = views(spark, sf, "bad_actor_monitoring")
    cur = S.snapshot(t, "periode", "latest").filter(S.not_in("status", S.BAD_ACTOR_CLOSED))
    prev = S.snapshot(t, "periode", "previous")
    return S.bad_actor_trend(cur, prev)


# -------------------------------------------------------------- daily / weekly / monthly packs
def _section_where(cadence: str, sec: S.Section) -> str:
    if sec.which == "previous":
        return ""
    if sec.table == "readiness_jetty":
        return JETTY_WEEKLY if cadence == "weekly" else JETTY_MONTHLY
    return WHERE[sec.table]


def _pack_sql(cadence: str) -> str:
    parts = []
    for name, sec in S.SECTIONS[cadence].items():
        order = ", ".join([f"{c} ASC NULLS LAST" for c in sec.order] + ["id"])
        parts.append(f"SELECT '{name}' AS section, count(*) AS n_rows, "
                     f"coalesce(to_json(list(t ORDER BY {order})), '[]')::varchar AS payload "
                     f"FROM ({_sql(sec, _section_where(cadence, sec))}) t")
    return "\nUNION ALL\n".join(parts)


def _pack(cadence: str):
    @register(f"pack_{cadence}", _pack_sql(cadence))
    def q(spark, sf):
        from pyspark.sql import functions as F
        from upkeep.operators.packs import pack_json
        secs = S.SECTIONS[cadence]
        tables = {t: views(spark, sf, t)[0] for t in {s.table for s in secs.values()}}
        built = S.gather(tables, cadence)
        return pack_json({name: (built[name], [F.asc_nulls_last(c) for c in sec.order] + ["id"])
                          for name, sec in secs.items()})
    return q


for _cad in ("daily", "weekly", "monthly"):
    _pack(_cad)
