"""Day-count bucketing (``CASE WHEN days BETWEEN lo AND hi``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Overdue-aging bucket labels and their inclusive day ranges,
# in display order; days outside every range fall in the last label.
AGING_BUCKETS = [
    ("1-7 hari", 1, 7),
    ("8-30 hari", 8, 30),
    ("31-90 hari", 31, 90),
    ("91-180 hari", 91, 180),
]
AGING_REST = ">180 hari"


def aging_bucket(days: Column, buckets=AGING_BUCKETS, rest: str = AGING_REST) -> Column:
    expr = None
    for label, lo, hi in buckets:
        cond = days.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(rest))


def bucket_dates(label: str, date: Column, as_of: Column, buckets=AGING_BUCKETS) -> Column:
    """Drill-down predicate for a bucket label, as a range of dates before
    ``as_of`` so that both bounds reach the scan.

    A label is recognised by containing a range text ("1-7", ...); anything
    unrecognised selects the open-ended rest (days > last upper bound).
    """
    for _, lo, hi in buckets:
        if f"{lo}-{hi}" in (label or ""):
            return (date >= F.date_sub(as_of, hi)) & (date <= F.date_sub(as_of, lo))
    return date < F.date_sub(as_of, buckets[-1][2])
