"""Registered control-tower worklists."""

from __future__ import annotations

from upkeep.operators import worklists as W
from upkeep.plans.q_analytics import FLAGGED
from upkeep.plans.registry import register, views
from upkeep.sources.fixtures import AS_OF

D = "DATE '2001-06-30'"


def _cols(cols):
    return ", ".join(cols)


@register("ct_backlog", f"""
WITH {FLAGGED}
SELECT id, {_cols(W.BACKLOG_COLS)} FROM nt WHERE NOT ordered AND contains(lower(system_status), 'osno')
ORDER BY required_end ASC NULLS LAST, id LIMIT 50""")
def q_ct_backlog(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return W.backlog(n)


@register("ct_overdue_notif", f"""
WITH {FLAGGED}
SELECT id, {_cols(W.OVERDUE_NOTIF_COLS)} FROM nt WHERE NOT ordered AND date_diff('day', required_end, {D}) > 0
ORDER BY required_end ASC NULLS LAST, id LIMIT 30""")
def q_ct_overdue_notif(spark, sf):
    (n,) = views(spark, sf, "notifications")
    return W.overdue_notifications(n, AS_OF)


@register("ct_stagnant", f"""
WITH {FLAGGED}
SELECT id, {_cols(W.STAGNANT_COLS)} FROM wo WHERE rel AND actual_finish IS NULL
ORDER BY basic_fin_date ASC NULLS LAST, id LIMIT 50""")
def q_ct_stagnant(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return W.stagnant(w)


@register("ct_overdue_wo", f"""
WITH {FLAGGED}
SELECT id, {_cols(W.OVERDUE_WO_COLS)} FROM wo WHERE date_diff('day', basic_fin_date, {D}) > 0 AND system_status IS NOT NULL AND NOT (teco OR clsd)
ORDER BY basic_fin_date ASC NULLS LAST, id LIMIT 30""")
def q_ct_overdue_wo(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return W.overdue_orders(w, AS_OF)


@register("ct_pending_release", f"""
WITH {FLAGGED}
SELECT id, {_cols(W.PENDING_COLS)} FROM wo WHERE crtd AND NOT rel
ORDER BY bas_start_date ASC NULLS LAST, id LIMIT 20""")
def q_ct_pending(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return W.pending_release(w)


@register("ct_teco_no_finish", f"""
WITH {FLAGGED}
SELECT id, {_cols(W.TECO_NO_FINISH_COLS)} FROM wo WHERE teco AND actual_finish IS NULL
ORDER BY basic_fin_date ASC NULLS LAST, id""")
def q_ct_teco(spark, sf):
    (w,) = views(spark, sf, "work_orders")
    return W.teco_without_finish(w)
