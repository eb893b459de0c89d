"""Predicates and small expressions shared by every operator.

Status strings hold space separated tokens ("CRTD MANC").  All status tests
are case-insensitive substring tests with SQL three-valued logic: a NULL
status makes both ``has_status`` and ``lacks_status`` NULL, so a filter on
either drops the row while ``sum(when(..))`` counts it as 0.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_date(as_of=None) -> Column:
    """The reporting date: a literal when given, else ``current_date()``."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def is_blank(c) -> Column:
    """``x IS NULL OR x = ''`` (never NULL itself)."""
    c = _c(c)
    return c.isNull() | (c == F.lit(""))


def not_blank(c) -> Column:
    """``x IS NOT NULL AND x != ''``."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def has_status(c, token: str) -> Column:
    """``c ILIKE '%TOKEN%'``."""
    return _c(c).ilike(f"%{token}%")


def lacks_status(c, token: str) -> Column:
    """``c NOT ILIKE '%TOKEN%'`` (NULL stays NULL)."""
    return ~has_status(c, token)


# The status words that operators test for.
STATUS_WORDS = ["CRTD", "REL", "TECO", "CLSD", "OSNO"]


def status_flag(token: str) -> str:
    """Name of the flag column of a status word."""
    return f"status_{token.lower()}"


def with_status_flags(df: DataFrame, status: str = "system_status") -> DataFrame:
    """``df`` with one boolean column per status word: the outcome of its text
    test, NULL for a NULL status.  Written once with the table, a flag is a
    filter that the scan can take, which the text test is not."""
    return df.withColumns({status_flag(t): has_status(status, t) for t in STATUS_WORDS})


def tests_status(df: DataFrame, token: str, alias: str | None = None) -> Column:
    """``has_status`` on the rows of ``df`` (under ``alias``, if it is joined):
    by its flag column where the table has one, else by the text."""
    at = f"{alias}." if alias else ""
    if status_flag(token) in df.columns:
        return F.col(at + status_flag(token))
    return has_status(at + "system_status", token)


def lower_or_empty(c) -> Column:
    """``LOWER(COALESCE(x, ''))``."""
    return F.lower(F.coalesce(_c(c), F.lit("")))


def trimmed_or_empty(c) -> Column:
    """``TRIM(COALESCE(x, ''))``."""
    return F.trim(F.coalesce(_c(c), F.lit("")))


def preview(c, n: int) -> Column:
    """``LEFT(text, n)`` for display columns."""
    return F.substring(_c(c), 1, n)


def days_between(later, earlier) -> Column:
    """``(later - earlier)::INTEGER`` in days."""
    return F.datediff(_c(later), _c(earlier))


def month_label(c) -> Column:
    """``TO_CHAR(d, 'YYYY-MM')``."""
    return F.date_format(_c(c), "yyyy-MM")


def in_month(c, month: str) -> Column:
    """Whether a date lies in month ``YYYY-MM``: a half-open range, which
    reaches the scan as a filter.  Text that is no month matches nothing."""
    try:
        first = _dt.date.fromisoformat(f"{month}-01")
    except ValueError:
        return F.lit(False)
    nxt = (first.replace(day=28) + _dt.timedelta(days=4)).replace(day=1)
    return (_c(c) >= F.lit(first)) & (_c(c) < F.lit(nxt))


def month_floor(as_of, months_back: int) -> Column:
    """``DATE_TRUNC('month', as_of - INTERVAL 'n months')`` as a DATE."""
    return F.trunc(F.add_months(as_of_date(as_of), -months_back), "MM")
