"""Column builders shared by all operators (built-in Spark expressions only)."""

from ledgerlens.functions.measures import (
    amount_if,
    decimal_avg,
    hour_between,
    money,
    n_if,
    n_status,
    rate_pct,
    seconds_of_day,
    status_is,
    time_band,
    time_band_sort,
    transaction_time,
)
from ledgerlens.functions.sizing import bounded_broadcast, fits_broadcast, row_count

__all__ = [
    "amount_if", "decimal_avg", "hour_between", "money", "n_if", "n_status", "rate_pct",
    "seconds_of_day", "status_is", "time_band", "time_band_sort", "transaction_time",
    "bounded_broadcast", "fits_broadcast", "row_count",
]
