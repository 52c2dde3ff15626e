"""Measure and dimension expressions used by the KPI, pattern and view operators.

All builders return ``Column`` objects made of built-in functions, so they stay
inside whole-stage codegen.  Money stays DECIMAL end to end; rates are computed
as DECIMAL and rounded HALF_UP like the reference engine does.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S

_HUNDRED = Decimal("100.0")

# Scale of a "x * 100.0 / n" quotient in the reference engine: 1 + 4 digits.
RATE_QUOTIENT_SCALE = 5

# Result types of SUM / AVG over a DECIMAL(12,2) column.
SUM_TYPE = T.DecimalType(S.MONEY.precision + 10, S.MONEY.scale)
AVG_TYPE = T.DecimalType(S.MONEY.precision + 4, S.MONEY.scale + 4)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_is(status: str, col: str = "transaction_status") -> Column:
    return F.col(col) == F.lit(status)


def n_if(cond: Column, global_agg: bool = False) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` (BIGINT).

    Inside GROUP BY every group has rows, so this equals ``count_if(cond)``.
    Only an aggregate without GROUP BY over an empty input differs (SUM gives
    NULL): pass ``global_agg=True`` there to keep the SUM form.
    """
    if global_agg:
        return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0)))
    return F.count_if(cond)


def n_status(status: str, col: str = "transaction_status", global_agg: bool = False) -> Column:
    return n_if(status_is(status, col), global_agg)


def amount_if(cond: Column, amount: str | Column = "amount") -> Column:
    """``SUM(CASE WHEN cond THEN amount ELSE 0 END)`` kept in DECIMAL."""
    return F.sum(F.when(cond, _col(amount)).otherwise(F.lit(Decimal("0")).cast(S.MONEY)))


def money(c: str | Column) -> Column:
    """``ROUND(x, 2)`` on a DECIMAL (HALF_UP)."""
    return F.round(_col(c), 2)


def rate_pct(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """``ROUND(num * 100.0 / den, 2)``; NULL when ``den`` is 0 or NULL (never raises).

    The reference engine returns a decimal quotient with the dividend's scale
    plus 4 digits (here 1 + 4 = 5), rounded half up, and ROUND applies to that;
    the quotient is cast to 5 decimals first so results agree at every tie.
    """
    quotient = F.try_divide(_col(num) * F.lit(_HUNDRED), _col(den))
    return F.round(quotient.cast(T.DecimalType(38, RATE_QUOTIENT_SCALE)), scale)


def decimal_avg(total: str | Column, count: str | Column) -> Column:
    """AVG of a money column recombined from a partial SUM and COUNT.

    Reproduces Spark's own DECIMAL average (sum / count at the division's scale,
    then cast to DECIMAL(16,6)), so an aggregate pushed below a join returns
    exactly what ``avg(amount)`` over the joined rows would.
    """
    return (_col(total).cast(SUM_TYPE) / _col(count).cast(T.DecimalType(20, 0))).cast(AVG_TYPE)


def seconds_of_day(ts: str | Column = "transaction_ts") -> Column:
    """Whole seconds since midnight (INT)."""
    c = _col(ts)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


#: column of stored transactions that holds the hour of their time
HOUR = "transaction_hour"


def hour_of(df: DataFrame) -> Column:
    """Hour of day of a frame's transactions: the stored column where there is one, so that a filter
    on it reaches the files, else taken from the time."""
    return F.col(HOUR) if HOUR in df.columns else F.hour("transaction_ts")


def hour_between(first: int, last: int, hour: Column | None = None) -> Column:
    """``HOUR(transaction_time) BETWEEN first AND last``."""
    return (F.hour("transaction_ts") if hour is None else hour).between(first, last)


def transaction_time(ts: str | Column = "transaction_ts") -> Column:
    """Time of day as ``HH:mm:ss`` text (the reference's TIME column)."""
    return F.date_format(_col(ts), "HH:mm:ss")


def _band_expr(pick: int, hour: Column | None) -> Column:
    expr = None
    for band in S.TIME_BANDS:
        cond = hour_between(band[2], band[3], hour)
        val = F.lit(band[pick])
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr  # no ELSE: NULL outside the four bands, as declared


def time_band(hour: Column | None = None) -> Column:
    return _band_expr(0, hour)


def time_band_sort(hour: Column | None = None) -> Column:
    return _band_expr(1, hour)
