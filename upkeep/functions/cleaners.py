"""Cell cleaners applied while ingesting header-labelled exports.

Each cleaner maps one raw (string) cell to a typed value and never fails:
bad input becomes NULL.  ANSI mode is on by default in Spark 4, so every
conversion uses a ``try_`` form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that mark "has long text" in a notification export.
LONG_TEXT_TRUE = ["X", "x", "1", "True"]

# Fixed value: the date layout of text date cells in tabular exports.
EXPORT_DATE_FORMAT = "yyyy-MM-dd"

# The shape of such a cell; a time of day may follow the date.
ISO_CELL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"

# Every character Python's ``str.strip()`` removes (all Unicode whitespace;
# the highest is U+3000), derived from the rule rather than listed.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip_ws(c: Column) -> Column:
    """Trim leading/trailing whitespace of any kind (space, tab, newline, NBSP...).

    A text that begins and ends with a printing ASCII character, the usual cell,
    is left as it is: ``btrim`` with a list looks every character up in it.
    """
    plain = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def clean_string(c: Column) -> Column:
    """NULL -> NULL; trimmed; blank -> NULL."""
    return F.nullif(strip_ws(c.cast("string")), F.lit(""))


def clean_date(c: Column, source_type: T.DataType | None = None,
               fmt: str = EXPORT_DATE_FORMAT) -> Column:
    """Real date/time cells keep their date; text is parsed with one declared
    layout and anything that does not parse (e.g. ``2024-13-40``) is NULL."""
    if isinstance(source_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    text = strip_ws(c.cast("string"))
    if fmt == EXPORT_DATE_FORMAT:
        # The whole cell must be an ISO date, with a time part or without; the
        # plain cast alone would also take "2024", "2024-5" or trailing text.
        # A bare date, the usual cell, is tested without a regular expression.
        bare = ((F.length(text) == 10) & (text >= F.lit("0")) & (F.substring(text, 5, 1) == "-")
                & (F.substring(text, 8, 1) == "-"))
        return F.when(bare, text.try_cast("date")).when(
            (F.length(text) > 10) & text.rlike(ISO_CELL), F.substring(text, 1, 10).try_cast("date"))
    return F.try_to_date(text, fmt)


def clean_number(c: Column, scale: int = 2, precision: int = 18) -> Column:
    """Number or NULL (text, ``n/a``, overflow) as DECIMAL(precision, scale),
    rounded half-up from the decimal text (no binary floating point step,
    so ``0.285`` becomes 0.29 as a NUMERIC column stores it).  No number begins
    with an ASCII letter: such a cell is not handed to the cast, whose way of
    refusing a text is an exception."""
    text = strip_ws(c.cast("string"))
    return F.when(~F.coalesce(F.substring(text, 1, 1).between("A", "z"), F.lit(False)),
                  text.try_cast(T.DecimalType(precision, scale)))


def long_text_flag(c: Column, source_type: T.DataType | None = None) -> Column:
    """True when the trimmed cell is one of the long-text markers (a typed
    boolean cell counts as its own value)."""
    if isinstance(source_type, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(strip_ws(c.cast("string")).isin(LONG_TEXT_TRUE), F.lit(False))


def clean_cell(cell: Column, kind: str, scale: int | None = None) -> Column:
    """A workbook cell (struct of kind and text) as a value of a layout column:
    text as it would be written, dates from date cells only (a text that looks
    like one is none), numbers also from booleans."""
    text = cell["text"]
    if kind == "d":
        return F.when(cell["kind"] == "d", F.substring(text, 1, 10).try_cast("date"))
    if kind == "n":
        number = F.when(cell["kind"] == "b", F.when(text == "True", F.lit("1")).otherwise(F.lit("0"))).otherwise(text)
        return clean_number(number, scale)
    if kind == "b":
        return long_text_flag(text)
    return clean_string(text)
