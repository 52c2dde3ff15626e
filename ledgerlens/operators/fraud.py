"""Fraud KPIs (2a-2e).

2e (and view V2) join transactions *and* flags to accounts on ``account_id``
alone, so the reference multiplies rows: an account with n transactions and m
flags contributes n*m joined rows.  That fan-out is what the reference reports
and stays the default, but it is computed without the exploding join: both
facts are aggregated per account (partial aggregates, skew-safe), joined to the
account dimension, and multiplied by ``max(m, 1)`` / ``max(n, 1)``.
``fan_out=False`` returns the true per-account counts instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.measures import (
    amount_if,
    money,
    n_status,
    rate_pct,
    status_is,
)
from ledgerlens.sources.tables import Tables


def overall_fraud_rate(tables: Tables) -> DataFrame:
    """2a. One row: total, flagged, fraud rate and flagged value."""
    return (tables.transactions
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 n_status(S.FLAGGED, global_agg=True).alias("flagged_count"),
                 money(amount_if(status_is(S.FLAGGED))).alias("total_flagged_amount"))
            .select("total_transactions", "flagged_count",
                    rate_pct("flagged_count", "total_transactions").alias("fraud_rate_pct"),
                    "total_flagged_amount"))


def flag_status_breakdown(tables: Tables) -> DataFrame:
    """2b. Flags per status with share of all flags and resolved / open counts.

    The share uses a window over the *aggregated* rows (one per status), never
    over raw flags, so the single-partition window sees only a handful of rows.
    """
    per_status = (tables.fraud_flags
                  .groupBy("flag_status")
                  .agg(F.count(F.lit(1)).alias("flag_count"),
                       F.count(F.when(F.col("resolution_date").isNotNull(), F.lit(1)))
                       .alias("resolved_count"),
                       F.count(F.when(F.col("resolution_date").isNull(), F.lit(1)))
                       .alias("unresolved_count")))
    everything = Window.partitionBy()
    return per_status.select(
        "flag_status", "flag_count",
        rate_pct("flag_count", F.sum("flag_count").over(everything)).alias("pct_of_flags"),
        "resolved_count", "unresolved_count")


def by_flag_reason(tables: Tables) -> DataFrame:
    """2c. Flags per reason split by outcome, most confirmed first."""
    st = "flag_status"
    return (tables.fraud_flags
            .groupBy("flag_reason")
            .agg(F.count(F.lit(1)).alias("occurrence_count"),
                 n_status(S.CONFIRMED_FRAUD, st).alias("confirmed_fraud"),
                 n_status(S.FALSE_POSITIVE, st).alias("false_positives"),
                 n_status(S.UNDER_REVIEW, st).alias("under_review"))
            .orderBy(F.col("confirmed_fraud").desc(), "flag_reason"))


def by_flag_source(tables: Tables) -> DataFrame:
    """2d. Flags raised and confirmation rate per source, best rate first."""
    return (tables.fraud_flags
            .groupBy("flagged_by")
            .agg(F.count(F.lit(1)).alias("flags_raised"),
                 n_status(S.CONFIRMED_FRAUD, "flag_status").alias("confirmed"))
            .withColumn("confirmation_rate_pct", rate_pct("confirmed", "flags_raised"))
            .orderBy(F.col("confirmation_rate_pct").desc(), "flagged_by"))


# ---------------------------------------------------------------------------
# Account-level profile shared by 2e and view V2
# ---------------------------------------------------------------------------

def per_account_transactions(transactions: DataFrame) -> DataFrame:
    return (transactions
            .groupBy("account_id")
            .agg(F.count("transaction_id").alias("_n"),
                 F.sum("amount").alias("_sum"),
                 n_status(S.FLAGGED).alias("_fl"),
                 amount_if(status_is(S.FLAGGED)).alias("_fl_sum")))


def per_account_flags(flags: DataFrame) -> DataFrame:
    st = "flag_status"
    return (flags
            .groupBy("account_id")
            .agg(F.count("flag_id").alias("_m"),
                 n_status(S.CONFIRMED_FRAUD, st).alias("_conf"),
                 n_status(S.UNDER_REVIEW, st).alias("_rev")))


#: products of two row counts: wider than BIGINT, which they can exceed on one hot account
WIDE_COUNT = "decimal(38,0)"


def account_fraud_profile(tables: Tables, account_cols: list[str], fan_out: bool = True,
                          flagged_only: bool = False) -> DataFrame:
    """Accounts left-joined to per-account transaction and flag aggregates.

    Output columns: ``account_cols`` plus total_transactions,
    total_transaction_value, flagged_count, flagged_amount, total_flags,
    confirmed_fraud_count, under_review_count with the reference's NULL rules:
    value is NULL without transactions; the CASE-based sums are 0.  Counts are
    DECIMAL(38,0) with ``fan_out`` (they are products) and BIGINT without.

    ``flagged_only`` keeps accounts with a flagged transaction.  Fan-out never
    turns a zero into more, so the rule is applied to the transaction aggregate,
    below both joins.
    """
    a = tables.accounts.select(*account_cols)
    tx = per_account_transactions(tables.transactions)
    if flagged_only:
        tx = tx.where("_fl > 0")
    fl = per_account_flags(tables.fraud_flags)
    j = a.join(tx, "account_id", "inner" if flagged_only else "left").join(fl, "account_id", "left")

    def count(column: str) -> Column:
        n = F.coalesce(F.col(column), F.lit(0))
        return n.cast(WIDE_COUNT) if fan_out else n

    one = F.lit(1).cast(WIDE_COUNT) if fan_out else F.lit(1)
    n, m = count("_n"), count("_m")
    t_mult: Column = F.greatest(m, one) if fan_out else one
    f_mult: Column = F.greatest(n, one) if fan_out else one

    def times(x: Column, by: Column) -> Column:
        return (x * by).cast(WIDE_COUNT) if fan_out else x

    def value(x: Column) -> Column:
        return money(x.cast("decimal(38,2)") * t_mult) if fan_out else money(x)

    return j.select(
        *account_cols,
        times(n, t_mult).alias("total_transactions"),
        value(F.col("_sum")).alias("total_transaction_value"),
        times(count("_fl"), t_mult).alias("flagged_count"),
        value(F.coalesce(F.col("_fl_sum"), F.lit(0).cast(S.MONEY))).alias("flagged_amount"),
        times(m, f_mult).alias("total_flags"),
        times(count("_conf"), f_mult).alias("confirmed_fraud_count"),
        times(count("_rev"), f_mult).alias("under_review_count"),
    )


def high_risk_accounts(tables: Tables, fan_out: bool = True, ordered: bool = True) -> DataFrame:
    """2e. Accounts with at least one flagged transaction, most confirmed first
    (``ordered=False`` skips the global sort)."""
    cols = ["account_id", "full_name", "account_status", "risk_tier", "kyc_status"]
    out = account_fraud_profile(tables, cols, fan_out, flagged_only=True).select(
        *cols, "total_transactions",
        F.col("flagged_count").alias("flagged_transactions"),
        F.col("flagged_amount").alias("total_flagged_amount"),
        "total_flags", "confirmed_fraud_count")
    return out.orderBy(F.col("confirmed_fraud_count").desc(), "account_id") if ordered else out
