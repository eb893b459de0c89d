"""Terminal display step: every column to text, NULL shown as a dash.

Integers and booleans show as numbers with a decimal place, as the original
formatter's conversion to floating point did; other numbers keep two places.
All cells become text.

Kept out of the operators: it is applied to a (small, already limited)
result just before it is handed to a renderer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text shown for a missing value.
NULL_MARK = "—"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def display_format(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        t = f.dataType
        if isinstance(t, T.DateType):
            s = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            s = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(t, _INTEGRAL):      # numbers show a decimal place: 3 -> 3.0
            s = F.concat(c.cast("string"), F.lit(".0"))
        elif isinstance(t, _FRACTIONAL):
            s = F.round(c.cast(T.DecimalType(38, 6)), 2).cast(T.DecimalType(38, 2)).cast("string")
        elif isinstance(t, T.BooleanType):  # as numbers: 1.0 and 0.0
            s = F.when(c, "1.0").when(~c, "0.0")
        else:
            s = c.cast("string")
        cols.append(F.coalesce(s, F.lit(NULL_MARK)).alias(f.name))
    return df.select(*cols)
