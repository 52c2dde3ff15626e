"""Interval self-join: pairs of rows of one key whose timestamps are close.

The reference pairs each transaction with *every* earlier transaction of the
same account and day whose whole-minute distance (TIMESTAMPDIFF truncates) lies
in [min_minutes, max_minutes].  For elapsed time d that is
``min*60s <= d < (max+1)*60s`` (with min >= 1), or ``-60s < d < (max+1)*60s``
when min is 0, since truncation maps small negative gaps to 0 as well.

A join on (account, day) alone compares all pairs of a day, which is quadratic
in the busiest account-day.  Here both sides also carry a time bucket of width
``2 * span``: the "current" row sits in one bucket, the "previous" row is copied
into the (at most two) buckets that its admissible window touches.  The equi-key
(account, bucket[, day]) spreads a hot account over many tasks, each comparing
only rows at most two buckets apart; the exact time condition is the residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.measures import seconds_of_day


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ (BIGINT)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(F.to_date(c)).cast("long") * 86400 + seconds_of_day(c)


def utc_instant(ts: str | Column) -> Column:
    """The wall-clock TIMESTAMP_NTZ read as UTC, as a TIMESTAMP (exact to the microsecond).

    Independent of the session time zone, so no DST shift can reorder rows.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    micros = (F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000
              + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
              + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long"))
    return F.timestamp_micros(micros)


def time_window_pairs(df: DataFrame, key: str, ts: str, row_id: str,
                      min_minutes: int, max_minutes: int, same_day_col: str | None,
                      cur_cols: dict[str, str], prev_cols: dict[str, str]) -> DataFrame:
    """All (current, previous) row pairs of one key with the minute distance in range.

    ``cur_cols`` / ``prev_cols`` map source columns to output names for each side.
    Output: those columns, ``minutes_apart`` (BIGINT, truncated whole minutes) and
    the two timestamps as ``cur_ts`` / ``prev_ts``.
    """
    if min_minutes < 0 or max_minutes < min_minutes:
        raise ValueError("need 0 <= min_minutes <= max_minutes")
    lo = min_minutes * 60 if min_minutes > 0 else -59      # inclusive, in whole seconds
    hi = (max_minutes + 1) * 60                               # exclusive
    width = 2 * (hi - lo + 2)
    sec = epoch_seconds(ts)

    needed = {key, ts, row_id, *cur_cols, *prev_cols} | ({same_day_col} if same_day_col else set())
    base = df.select(*sorted(needed))

    cur = base.select(
        F.col(key).alias("_k"), F.col(ts).alias("_ts_c"), F.col(row_id).alias("_id_c"),
        *([F.col(same_day_col).alias("_d_c")] if same_day_col else []),
        F.floor(sec / F.lit(width)).alias("_b"),
        *[F.col(c).alias(o) for c, o in cur_cols.items()])

    # A previous row at second s pairs with current rows in [s+lo-1, s+hi+1]
    # (one second of slack for sub-second parts); that range spans <= 2 buckets.
    b_first = F.floor((sec + F.lit(lo - 1)) / F.lit(width))
    b_last = F.floor((sec + F.lit(hi + 1)) / F.lit(width))
    prev = base.select(
        F.col(key).alias("_k2"), F.col(ts).alias("_ts_p"), F.col(row_id).alias("_id_p"),
        *([F.col(same_day_col).alias("_d_p")] if same_day_col else []),
        F.explode(F.when(b_first == b_last, F.array(b_first))
                   .otherwise(F.array(b_first, b_last))).alias("_b2"),
        *[F.col(c).alias(o) for c, o in prev_cols.items()])

    # wall clocks read as instants of UTC: a difference of NTZ values would take the session
    # zone's gaps into account
    elapsed_min = F.timestamp_diff("MINUTE", utc_instant("_ts_p"), utc_instant("_ts_c"))
    cond = [F.col("_k") == F.col("_k2"), F.col("_b") == F.col("_b2"),
            F.col("_id_c") != F.col("_id_p")]
    if same_day_col:
        cond.append(F.col("_d_c") == F.col("_d_p"))
    if min_minutes > 0:
        cond.append(F.col("_ts_c") >= F.col("_ts_p") + F.make_dt_interval(
            mins=F.lit(min_minutes)))
    else:
        cond.append(F.col("_ts_c") > F.col("_ts_p") - F.make_dt_interval(mins=F.lit(1)))
    cond.append(F.col("_ts_c") < F.col("_ts_p") + F.make_dt_interval(mins=F.lit(max_minutes + 1)))

    cond_all = cond[0]
    for c in cond[1:]:
        cond_all = cond_all & c
    # Both sides are fact-sized: a shuffle sort-merge join on (key, bucket[, day]),
    # never a broadcast of one side; AQE splits skewed key partitions.
    return cur.join(prev.hint("merge"), cond_all, "inner").select(
        *cur_cols.values(), *prev_cols.values(), elapsed_min.alias("minutes_apart"),
        F.col("_ts_c").alias("cur_ts"), F.col("_ts_p").alias("prev_ts"))
