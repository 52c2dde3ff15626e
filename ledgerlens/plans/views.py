"""Reporting views V1-V6 and their publication (temp views or Parquet marts).

A view is a function from the table bundle to a lazy DataFrame.
``register_views`` stores each plan under its name in the session catalog (the
plan re-runs at each use, like a SQL view); ``write_marts`` materialises each
view to Parquet, partitioned by month where the view has one, for a BI tool to
read as files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.measures import (
    amount_if,
    hour_between,
    hour_of,
    money,
    n_if,
    n_status,
    rate_pct,
    status_is,
    time_band,
    time_band_sort,
)
from ledgerlens.functions.sizing import bounded_broadcast
from ledgerlens.operators.fraud import account_fraud_profile
from ledgerlens.operators.patterns import velocity_base
from ledgerlens.sources.publish import publish, read_published
from ledgerlens.sources.tables import Tables


def monthly_fraud_summary(tables: Tables) -> DataFrame:
    """V1. Status counts, value, fraud rate and time-of-day counts per month."""
    band, hour = {b[1]: b for b in S.TIME_BANDS}, hour_of(tables.transactions)
    night = hour_between(band[1][2], band[1][3], hour)
    return (tables.transactions
            .groupBy("transaction_month")
            .agg(F.count("transaction_id").alias("total_transactions"),
                 n_status(S.SUCCESS).alias("successful_count"),
                 n_status(S.FAILED).alias("failed_count"),
                 n_status(S.FLAGGED).alias("flagged_count"),
                 n_status(S.REVERSED).alias("reversed_count"),
                 money(amount_if(status_is(S.SUCCESS))).alias("successful_revenue"),
                 money(amount_if(status_is(S.FLAGGED))).alias("flagged_amount"),
                 F.count(F.lit(1)).alias("_rows"),
                 n_if(night).alias("late_night_txns"),
                 n_if(hour_between(band[2][2], band[2][3], hour)).alias("morning_txns"),
                 n_if(hour_between(band[3][2], band[3][3], hour)).alias("afternoon_txns"),
                 n_if(hour_between(band[4][2], band[4][3], hour)).alias("evening_txns"),
                 n_if(night & status_is(S.FLAGGED)).alias("late_night_flagged"))
            .select("transaction_month", "total_transactions", "successful_count",
                    "failed_count", "flagged_count", "reversed_count", "successful_revenue",
                    "flagged_amount", rate_pct("flagged_count", "_rows").alias("fraud_rate_pct"),
                    "late_night_txns", "morning_txns", "afternoon_txns", "evening_txns",
                    "late_night_flagged"))


def account_risk_profile(tables: Tables, fan_out: bool = True) -> DataFrame:
    """V2. Every account with transaction and flag totals (reference fan-out by default)."""
    cols = ["account_id", "full_name", "region", "state", "account_type", "account_status",
            "kyc_status", "risk_tier", "registration_date"]
    return account_fraud_profile(tables, cols, fan_out)


def merchant_fraud_profile(tables: Tables) -> DataFrame:
    """V3. Every merchant with volume, value, mean and fraud rate.

    Merchants without transactions get counts 0 and NULL value / mean / rate;
    the rate divides by a zero count, which yields NULL instead of an error.
    """
    per_merchant = (tables.transactions
                    .groupBy("merchant_id")
                    .agg(F.count("transaction_id").alias("_n"),
                         F.sum("amount").alias("_sum"),
                         F.avg("amount").alias("_avg"),
                         n_status(S.FLAGGED).alias("_fl")))
    m = tables.merchants.select("merchant_id", "merchant_name", "merchant_category", "region",
                                "is_verified")
    zero = F.lit(0).cast("long")
    return (m.join(per_merchant, "merchant_id", "left")
             .select("merchant_id", "merchant_name", "merchant_category", "region", "is_verified",
                     F.coalesce("_n", zero).alias("total_transactions"),
                     money("_sum").alias("total_transaction_value"),
                     money("_avg").alias("avg_transaction_value"),
                     F.coalesce("_fl", zero).alias("flagged_count"),
                     rate_pct(F.coalesce("_fl", zero), F.coalesce("_n", zero))
                     .alias("fraud_rate_pct")))


def channel_device_performance(tables: Tables) -> DataFrame:
    """V4. Volume, value, outcomes and fraud rate per (channel, device type)."""
    return (tables.transactions
            .groupBy("channel", "device_type")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 money(F.sum("amount")).alias("total_amount"),
                 money(F.avg("amount")).alias("avg_amount"),
                 n_status(S.SUCCESS).alias("successful"),
                 n_status(S.FLAGGED).alias("flagged"))
            .withColumn("fraud_rate_pct", rate_pct("flagged", "total_transactions")))


def time_pattern_analysis(tables: Tables) -> DataFrame:
    """V5. Counts and value per (time band, month, channel, device type)."""
    return (tables.transactions
            .withColumn("time_band", time_band(hour_of(tables.transactions)))
            .withColumn("time_band_sort", time_band_sort(hour_of(tables.transactions)))
            .groupBy("time_band", "time_band_sort", "transaction_month", "channel", "device_type")
            .agg(F.count("transaction_id").alias("total_transactions"),
                 n_status(S.FLAGGED).alias("flagged_count"),
                 n_status(S.SUCCESS).alias("successful_count"),
                 F.count(F.lit(1)).alias("_rows"),
                 money(F.sum("amount")).alias("total_amount"),
                 money(amount_if(status_is(S.FLAGGED))).alias("flagged_amount"))
            .select("time_band", "time_band_sort", "transaction_month", "channel", "device_type",
                    "total_transactions", "flagged_count", "successful_count",
                    rate_pct("flagged_count", "_rows").alias("fraud_rate_pct"),
                    "total_amount", "flagged_amount"))


def velocity_events(tables: Tables, min_minutes: int = S.VELOCITY_MIN_MINUTES,
                    max_minutes: int = S.VELOCITY_MAX_MINUTES, same_day: bool = True) -> DataFrame:
    """V6. Velocity pairs with the account and the current transaction's merchant."""
    pairs = velocity_base(tables.transactions, min_minutes, max_minutes, same_day,
                      extra_cur={"merchant_id": "merchant_id"})
    a = tables.accounts.select("account_id", "full_name", "risk_tier", "kyc_status")
    m = tables.merchants.select("merchant_id", "merchant_name", "merchant_category",
                                "is_verified")
    return (pairs
            .join(bounded_broadcast(a), "account_id", "inner")
            .join(bounded_broadcast(m), "merchant_id", "inner")
            .select("account_id", "full_name", "risk_tier", "kyc_status",
                    F.col("current_txn").alias("txn_id"),
                    F.col("transaction_date").alias("txn_date"),
                    F.col("transaction_time").alias("txn_time"),
                    F.col("current_amount").alias("txn_amount"),
                    F.col("current_status").alias("txn_status"),
                    F.col("previous_txn").alias("prev_txn_id"),
                    F.col("previous_time").alias("prev_txn_time"),
                    F.col("previous_amount").alias("prev_txn_amount"),
                    "minutes_apart", "merchant_name", "merchant_category", "is_verified"))


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "vw_monthly_fraud_summary": monthly_fraud_summary,
    "vw_account_risk_profile": account_risk_profile,
    "vw_merchant_fraud_profile": merchant_fraud_profile,
    "vw_channel_device_performance": channel_device_performance,
    "vw_time_pattern_analysis": time_pattern_analysis,
    "vw_velocity_events": velocity_events,
}

# The time pattern mart is partitioned by month for month-sliced dashboards.  The
# monthly summary is one row a month and stays in one folder.
MART_PARTITIONS = {
    "vw_time_pattern_analysis": ["transaction_month"],
}


def register_tables(tables: Tables) -> list[str]:
    """Register the four model tables as temp views for SQL users.

    ``transactions`` also exposes ``transaction_time`` (``HH:mm:ss`` text) next to
    ``transaction_ts``, so queries written against a date + time layout read it.
    """
    views = tables.as_dict()
    views["transactions"] = tables.transactions.withColumn(
        "transaction_time", F.date_format("transaction_ts", "HH:mm:ss"))
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def register_views(tables: Tables, names: list[str] | None = None) -> list[str]:
    """Register the views as session temp views; returns the registered names."""
    chosen = list(VIEWS) if names is None else names
    for name in chosen:
        VIEWS[name](tables).createOrReplaceTempView(name)
    return chosen


def write_marts(tables: Tables, path: str, names: list[str] | None = None) -> dict[str, str]:
    """Publish views as Parquet under ``path/<view>``; returns view -> data folder.

    Every view is written in full to a new folder, and then its readers are switched to
    it (see :mod:`ledgerlens.sources.publish`): a dashboard that reads during a rewrite
    gets the old or the new mart.
    """
    chosen = list(VIEWS) if names is None else names
    out = {}
    for name in chosen:
        target = f"{path.rstrip('/')}/{name}"
        df, parts = VIEWS[name](tables), MART_PARTITIONS.get(name, [])
        # clustered first: a month of an aggregated view is one file, not one of every task
        version = publish(df.repartition(*parts) if parts else df, target, parts)
        out[name] = version.paths(target)[0]
    return out


def read_mart(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The published mart ``path/<name>`` as it is now."""
    return read_published(spark, f"{path.rstrip('/')}/{name}")


def register_marts(spark: SparkSession, path: str, names: list[str] | None = None) -> list[str]:
    """Registers the published marts as session temp views, at their present version."""
    chosen = list(VIEWS) if names is None else names
    for name in chosen:
        read_mart(spark, path, name).createOrReplaceTempView(name)
    return chosen
