"""Type normalisation at the comparison boundary.

Inside the library money is DECIMAL and dates are DATE.  Engines disagree on
the result types of SUM / AVG / division over decimals, so every result handed
to an external comparison is normalised the same way on both sides:
integers and whole decimals -> BIGINT, other decimals -> DOUBLE, dates and timestamps -> ISO text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        whole = isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0
        if isinstance(f.dataType, _INTEGRAL) or whole:
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(c.alias(f.name))
    return df.select(*cols)
