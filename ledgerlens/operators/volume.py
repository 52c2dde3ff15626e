"""Transaction volume and revenue KPIs (1a-1d).

Every KPI is a hash aggregate: Spark runs a partial aggregate per input split and
shuffles only one row per group and split, so a key holding a third of all rows
(a hot merchant or channel) costs no more than any other key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.measures import (
    amount_if,
    decimal_avg,
    money,
    n_status,
    rate_pct,
    status_is,
)
from ledgerlens.functions.sizing import fits_broadcast
from ledgerlens.sources.tables import Tables


def monthly_trend(tables: Tables) -> DataFrame:
    """1a. Counts per status and successful / flagged value per month."""
    return (tables.transactions
            .groupBy("transaction_month")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 n_status(S.SUCCESS).alias("successful"),
                 n_status(S.FAILED).alias("failed"),
                 n_status(S.FLAGGED).alias("flagged"),
                 n_status(S.REVERSED).alias("reversed"),
                 money(amount_if(status_is(S.SUCCESS))).alias("successful_revenue"),
                 money(amount_if(status_is(S.FLAGGED))).alias("flagged_amount"))
            .orderBy("transaction_month"))


def by_channel(tables: Tables) -> DataFrame:
    """1b. Volume, value and flag rate per channel, largest value first."""
    return (tables.transactions
            .groupBy("channel")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 money(F.sum("amount")).alias("total_amount"),
                 money(F.avg("amount")).alias("avg_transaction_value"),
                 n_status(S.FLAGGED).alias("flagged_count"))
            .withColumn("flag_rate_pct", rate_pct("flagged_count", "total_transactions"))
            .orderBy(F.col("total_amount").desc(), "channel"))


def by_device(tables: Tables) -> DataFrame:
    """1c. Volume, flags and mean value per device type, most flagged first."""
    return (tables.transactions
            .groupBy("device_type")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 n_status(S.FLAGGED).alias("flagged_count"),
                 money(F.avg("amount")).alias("avg_amount"))
            .select("device_type", "total_transactions", "flagged_count",
                    rate_pct("flagged_count", "total_transactions").alias("flag_rate_pct"),
                    "avg_amount")
            .orderBy(F.col("flagged_count").desc(), "device_type"))


def per_merchant_totals(transactions: DataFrame) -> DataFrame:
    """Per-merchant partial aggregate that every merchant-level report reuses.

    Aggregating the fact table to one row per merchant *before* joining the
    merchant dimension replaces a fact-sized join by a merchant-sized one.
    """
    return (transactions
            .groupBy("merchant_id")
            .agg(F.count("transaction_id").alias("n_txn"),
                 F.count("amount").alias("n_amount"),
                 F.sum("amount").alias("sum_amount"),
                 amount_if(status_is(S.SUCCESS)).alias("sum_success"),
                 n_status(S.FLAGGED).alias("n_flagged"),
                 amount_if(status_is(S.FLAGGED)).alias("sum_flagged")))


def with_category(tables: Tables) -> DataFrame | None:
    """Fact rows tagged with their merchant category by a map-side join, or None
    when the merchants table is too large to broadcast."""
    m = tables.merchants.select("merchant_id", "merchant_category")
    if not fits_broadcast(m):
        return None
    return tables.transactions.join(F.broadcast(m), "merchant_id", "inner")


def by_merchant_category(tables: Tables) -> DataFrame:
    """1d. Inner join to merchants, then revenue / flags / mean value per category.

    With a small merchants table the join happens map-side and rows aggregate
    straight to categories (one partial row per category and task).  With a
    large one, rows are first aggregated per merchant (partial aggregates) and
    only that merchant-sized result is joined.
    """
    tagged = with_category(tables)
    if tagged is not None:
        return (tagged
                .groupBy("merchant_category")
                .agg(F.count("transaction_id").alias("total_transactions"),
                     money(amount_if(status_is(S.SUCCESS))).alias("successful_revenue"),
                     n_status(S.FLAGGED).alias("flagged_count"),
                     money(F.avg("amount")).alias("avg_transaction_value"))
                .orderBy(F.col("flagged_count").desc(), "merchant_category"))
    m = tables.merchants.select("merchant_id", "merchant_category")
    per_merchant = per_merchant_totals(tables.transactions)
    joined = per_merchant.join(m, "merchant_id", "inner")
    return (joined
            .groupBy("merchant_category")
            .agg(F.sum("n_txn").alias("total_transactions"),
                 money(F.sum("sum_success")).alias("successful_revenue"),
                 F.sum("n_flagged").alias("flagged_count"),
                 money(decimal_avg(F.sum("sum_amount"), F.sum("n_amount")))
                 .alias("avg_transaction_value"))
            .orderBy(F.col("flagged_count").desc(), "merchant_category"))
