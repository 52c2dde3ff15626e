"""Per-key ordered windows that survive a key holding a large share of all rows.

``Window.partitionBy(key)`` sends every row of a key to one task.  When one
account carries a third of the fact table that task cannot finish.  The
operators here give exactly the numbers of the plain window and split a key
wherever it is large:

1. one aggregate finds the keys of more than ``target_rows`` rows (at most rows /
   target of them); all other rows take the plain window;
2. the rows of hot keys alone are range-partitioned on (key, order columns, tie) into
   chunks of about ``target_rows`` rows.  The cuts are quantiles of the rows
   themselves (Spark samples them), so neither outliers nor long runs of one
   value make a chunk large: the tie column cuts a run of equal values too;
3. the chunk number is stored with these rows by a checkpoint.  Chunks therefore
   stay what they are when a task is repeated after the loss of an executor;
4. the window runs per (key, chunk), and a summary of the chunks of keys that
   lie in more than one chunk (at most two rows a chunk) gives each chunk what
   the earlier ones contribute.  It is broadcast only below ``SUMMARY_ROWS``.

So one hot account costs a checkpoint of its own rows, not of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import settings
from ledgerlens.functions.sizing import bounded_broadcast, checkpointed

_CHUNK = "_chunk"
#: a summary has two rows a chunk at most; with more chunks than that it is shuffled
SUMMARY_ROWS = 200_000


def _hot_keys(df: DataFrame, key: str, target: int) -> tuple[DataFrame, int]:
    """``(keys, rows)``: the keys that more than ``target`` rows of ``df`` hold, and their rows in all."""
    sizes = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    keys = checkpointed(sizes.where(F.col("_n") > target))
    return keys.select("_hot"), keys.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()["rows"]


def _of_keys(df: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys`` (``left_semi``) or not (``left_anti``)."""
    return df.join(bounded_broadcast(keys), F.col(key).eqNullSafe(F.col("_hot")), how)


def _chunked(df: DataFrame, rows: int, target: int, *order: Column) -> DataFrame:
    """``df`` with its chunk number, range-partitioned on ``order`` and stored."""
    chunks = -(-rows // target)
    return checkpointed(df.repartitionByRange(chunks, *order).withColumn(_CHUNK, F.spark_partition_id()))


def _earlier(summary: DataFrame, key: str, rows: int, target: int) -> DataFrame:
    """Keys that lie in several chunks only: the summary that is joined back."""
    several = summary.withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(key)))
    several = several.where(F.col("_of") > 1).drop("_of")
    return F.broadcast(several) if 2 * -(-rows // target) <= SUMMARY_ROWS else several


def _before(key: str) -> Window:
    return Window.partitionBy(key).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, key: str, value: str, out: str, count_out: str,
                ts: str = "transaction_ts", tie: str = "transaction_id",
                target_rows: int | None = None, ordered: bool = True) -> DataFrame:
    """Running SUM(value) per key in (ts, tie) order plus the key's row count.

    Frame: ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW.  The result is sorted by
    (key, ts, tie); ``ordered=False`` skips that global sort, and then rows that are stored
    by key (a bucketed table) are not shuffled at all.
    """
    target = settings.SKEW_TARGET_ROWS if target_rows is None else target_rows
    keys, rows = _hot_keys(df, key, target)
    dtype = df.schema[value].dataType
    res_type = T.DecimalType(38, dtype.scale) if isinstance(dtype, T.DecimalType) else None

    def plain(x: DataFrame) -> DataFrame:
        w = Window.partitionBy(key)
        total = F.sum(value).over(w.orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return (x.withColumn(out, total.cast(res_type) if res_type else total)
                 .withColumn(count_out, F.count(F.lit(1)).over(w)))

    if not rows:
        return plain(df.repartitionByRange(key)).orderBy(key, ts, tie) if ordered else plain(df)
    split = _chunked_sum(_of_keys(df, key, keys, "left_semi"), rows, target, key, value, out, count_out, ts, tie, res_type)
    both = plain(_of_keys(df, key, keys, "left_anti")).unionByName(split)
    return both.orderBy(key, ts, tie) if ordered else both


def _chunked_sum(df: DataFrame, rows: int, target: int, key: str, value: str, out: str, count_out: str,
                 ts: str, tie: str, res_type: T.DataType | None) -> DataFrame:
    """:func:`running_sum` of ``rows`` rows by stored chunks, unsorted."""
    x = _chunked(df, rows, target, F.col(key), F.col(ts), F.col(tie))
    chunk = Window.partitionBy(key, _CHUNK)
    frame = Window.unboundedPreceding, Window.currentRow
    local = (x.withColumn("_local", F.sum(value).over(chunk.orderBy(ts, tie).rowsBetween(*frame)))
              .withColumn("_rows", F.count(F.lit(1)).over(chunk)))
    totals = x.groupBy(key, _CHUNK).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(key, _CHUNK, F.sum("_sum").over(_before(key)).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(key)).alias("_key_rows"))
    # SUM ignores NULLs: NULL only while neither this chunk nor any earlier one
    # has contributed a value
    local_sum, offset = F.col("_local"), F.col("_offset")
    total = F.when(local_sum.isNull(), offset).when(offset.isNull(), local_sum) \
             .otherwise(local_sum + offset)
    if res_type:
        total = total.cast(res_type)
    return (_joined_back(local, _earlier(offsets, key, rows, target), key)
                 .withColumn(out, total)
                 .withColumn(count_out, F.coalesce(F.col("_key_rows"), F.col("_rows")))
                 .drop(_CHUNK, "_local", "_rows", "_offset", "_key_rows"))


def _joined_back(local: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Chunked rows with what the summary says of their chunk; a NULL key is a key like any other."""
    there = summary.withColumnsRenamed({key: "_summary_key", _CHUNK: "_summary_chunk"})
    same = F.col(key).eqNullSafe(F.col("_summary_key")) & (F.col(_CHUNK) == F.col("_summary_chunk"))
    return local.join(there, same, "left").drop("_summary_key", "_summary_chunk")


def rank_desc(df: DataFrame, key: str, value: str, out: str, tie: str = "transaction_id",
              target_rows: int | None = None, ordered: bool = True) -> DataFrame:
    """RANK() OVER (PARTITION BY key ORDER BY value DESC), sorted by (key, rank, tie).

    The rank is BIGINT: a key may hold more than 2^31 rows.  NULL values rank
    last, as DESC does.  A chunk's rows rank among themselves, after all rows of
    the key in earlier chunks; only where a chunk begins inside a run of equal
    values do its first rows take the rank at which the run began.
    ``ordered=False`` skips the global sort, as in :func:`running_sum`.
    """
    target = settings.SKEW_TARGET_ROWS if target_rows is None else target_rows
    keys, rows = _hot_keys(df, key, target)
    falling = F.col(value).desc()

    def plain(x: DataFrame) -> DataFrame:
        return x.withColumn(out, F.rank().over(Window.partitionBy(key).orderBy(falling)).cast("long"))

    if not rows:
        return plain(df.repartitionByRange(key)).orderBy(key, falling, tie) if ordered else plain(df)
    split = _chunked_rank(_of_keys(df, key, keys, "left_semi"), rows, target, key, value, out, tie)
    both = plain(_of_keys(df, key, keys, "left_anti")).unionByName(split)
    return both.orderBy(key, falling, tie) if ordered else both


def _chunked_rank(df: DataFrame, rows: int, target: int, key: str, value: str, out: str, tie: str) -> DataFrame:
    """:func:`rank_desc` of ``rows`` rows by stored chunks, unsorted."""
    falling = F.col(value).desc()
    x = _chunked(df, rows, target, F.col(key), falling, F.col(tie))
    local = x.withColumn("_local", F.rank().over(
        Window.partitionBy(key, _CHUNK).orderBy(falling)).cast("long"))
    ends = local.groupBy(key, _CHUNK).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_local").alias("_last_rank"), F.max(value).alias("_first"),
        F.when(F.count(value) == F.count(F.lit(1)), F.min(value)).alias("_last"))
    ends = ends.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(key)), F.lit(0)))
    # where the last value of each chunk began to rank; of a run over chunks, the first of them
    began = (ends.groupBy(F.col(key).alias("_key"), F.col("_last").alias("_run"))
                 .agg(F.min(F.col("_offset") + F.col("_last_rank")).alias("_began")))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_first").eqNullSafe(F.col("_run"))
    offsets = ends.join(began, same, "left").select(key, _CHUNK, "_offset", "_began")
    rank = F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))
    rank = F.when(F.col("_local") == 1, F.least(rank, F.col("_began"))).otherwise(rank)
    return (_joined_back(local, _earlier(offsets, key, rows, target), key)
                 .withColumn(out, rank)
                 .drop(_CHUNK, "_local", "_offset", "_began"))
