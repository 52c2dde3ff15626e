"""Marts that grow with new batches: stored partial aggregates by month.

1a, V1, V4 and V5 need only row counts and sums per (month, hour, channel, device type, status).
:func:`add_batch` aggregates a batch to that grain and publishes it as a further part of the stored
partials; the reports then add up partials, so a new batch is all that is ever scanned of the
transactions.  A batch has a tag, and the same tag a second time changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.measures import HOUR, decimal_avg, hour_between, hour_of, money, rate_pct, time_band, time_band_sort
from ledgerlens.sources import publish as publishing

GRAIN = ["transaction_month", HOUR, "channel", "device_type", "transaction_status"]
#: parts of the stored partials from which on they are added up into one
COMPACT_PARTS = 32


def partials(transactions: DataFrame) -> DataFrame:
    """Counts and sums of transactions at the stored grain."""
    return (transactions.withColumn(HOUR, hour_of(transactions)).groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("n"), F.count("transaction_id").alias("n_ids"),
        F.count("amount").alias("n_amounts"), F.sum("amount").cast("decimal(38,2)").alias("amount")))


def merged(parts: DataFrame) -> DataFrame:
    """Partials of several batches added up."""
    return parts.groupBy(*GRAIN).agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"),
                                     F.sum("n_amounts").alias("n_amounts"), F.sum("amount").cast("decimal(38,2)").alias("amount"))


def add_batch(spark: SparkSession, path: str, batch: DataFrame, tag: str) -> publishing.Version:
    """Adds a batch of transactions to the partials at ``path``; only the batch is scanned."""
    version = publishing.publish_part(partials(batch).coalesce(1), path, tag)
    if len(version.folders) > COMPACT_PARTS:
        name, folder = publishing.new_folder(path)
        merged(publishing.read_published(spark, path, version=version)).coalesce(1).write.parquet(folder)
        version = publishing.replace(spark, path, version, name)
    return version


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The partials at ``path``, added up."""
    return merged(publishing.read_published(spark, path))


def _count(cond: Column, column: str = "n") -> Column:
    return F.sum(F.when(cond, F.col(column)).otherwise(F.lit(0)))


def _status(value: str) -> Column:
    return F.col("transaction_status") == value


def _value(cond: Column) -> Column:
    """Sum of amounts where ``cond`` holds; as over single rows, other rows count 0."""
    return money(F.sum(F.when(cond, F.col("amount")).otherwise(F.lit(0).cast("decimal(38,2)"))))


def monthly_trend(parts: DataFrame) -> DataFrame:
    """1a from partials."""
    return (parts.groupBy("transaction_month").agg(
        F.sum("n").alias("total_transactions"),
        *[_count(_status(v)).alias(a) for v, a in ((S.SUCCESS, "successful"), (S.FAILED, "failed"), (S.FLAGGED, "flagged"),
                                                   (S.REVERSED, "reversed"))],
        _value(_status(S.SUCCESS)).alias("successful_revenue"), _value(_status(S.FLAGGED)).alias("flagged_amount"))
        .orderBy("transaction_month"))


def monthly_fraud_summary(parts: DataFrame) -> DataFrame:
    """V1 from partials."""
    band, hour = {b[1]: b for b in S.TIME_BANDS}, F.col(HOUR)
    inside = {k: hour_between(b[2], b[3], hour) for k, b in band.items()}
    return (parts.groupBy("transaction_month").agg(
        F.sum("n_ids").alias("total_transactions"),
        *[_count(_status(v)).alias(a) for v, a in ((S.SUCCESS, "successful_count"), (S.FAILED, "failed_count"),
                                                   (S.FLAGGED, "flagged_count"), (S.REVERSED, "reversed_count"))],
        _value(_status(S.SUCCESS)).alias("successful_revenue"), _value(_status(S.FLAGGED)).alias("flagged_amount"),
        F.sum("n").alias("_rows"),
        *[_count(inside[k]).alias(a) for k, a in ((1, "late_night_txns"), (2, "morning_txns"), (3, "afternoon_txns"),
                                                  (4, "evening_txns"))],
        _count(inside[1] & _status(S.FLAGGED)).alias("late_night_flagged"))
        .withColumn("fraud_rate_pct", rate_pct("flagged_count", "_rows")).drop("_rows"))


def channel_device_performance(parts: DataFrame) -> DataFrame:
    """V4 from partials."""
    return (parts.groupBy("channel", "device_type").agg(
        F.sum("n").alias("total_transactions"), money(F.sum("amount")).alias("total_amount"),
        F.sum("amount").alias("_sum"), F.sum("n_amounts").alias("_n"),
        _count(_status(S.SUCCESS)).alias("successful"), _count(_status(S.FLAGGED)).alias("flagged"))
        .withColumn("avg_amount", money(decimal_avg("_sum", "_n")))
        .withColumn("fraud_rate_pct", rate_pct("flagged", "total_transactions")).drop("_sum", "_n"))


def time_pattern_analysis(parts: DataFrame) -> DataFrame:
    """V5 from partials."""
    hour = F.col(HOUR)
    keys = ["time_band", "time_band_sort", "transaction_month", "channel", "device_type"]
    return (parts.withColumns({"time_band": time_band(hour), "time_band_sort": time_band_sort(hour)})
            .groupBy(*keys).agg(
                F.sum("n_ids").alias("total_transactions"), _count(_status(S.FLAGGED)).alias("flagged_count"),
                _count(_status(S.SUCCESS)).alias("successful_count"), F.sum("n").alias("_rows"),
                money(F.sum("amount")).alias("total_amount"), _value(_status(S.FLAGGED)).alias("flagged_amount"))
            .withColumn("fraud_rate_pct", rate_pct("flagged_count", "_rows")).drop("_rows"))


REPORTS = {
    "kpi_1a_monthly_trend": monthly_trend,
    "vw_monthly_fraud_summary": monthly_fraud_summary,
    "vw_channel_device_performance": channel_device_performance,
    "vw_time_pattern_analysis": time_pattern_analysis,
}
