"""Pattern detection (3a-3f): windows, interval self-join, scoring, outliers.

Physical choices, all made for a fact table far larger than its dimensions:

* 3a / 3b use the chunked windows of :mod:`ledgerlens.operators.ordered`, so an
  account holding a third of all rows is still spread over many tasks;
* 3c uses the bucketed interval join of :mod:`ledgerlens.operators.interval`;
* 3d filters the fact table before joining the dimensions; a dimension is
  broadcast only when its row count is proven small (else shuffle join + AQE);
* 3e and 3f aggregate the fact table first (partial aggregates) and join the
  small aggregate, never the raw rows, to the dimension.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.measures import (
    decimal_avg,
    hour_between,
    hour_of,
    money,
    n_if,
    n_status,
    transaction_time,
)
from ledgerlens.functions.sizing import bounded_broadcast, checkpointed, fits_broadcast
from ledgerlens.operators.interval import time_window_pairs
from ledgerlens.operators.ordered import rank_desc, running_sum
from ledgerlens.operators.volume import per_merchant_totals, with_category
from ledgerlens.sources.tables import Tables


def running_total(tables: Tables, target_rows: int | None = None, ordered: bool = True) -> DataFrame:
    """3a. Cumulative spend per account in time order, plus the account's row count
    (``ordered=False`` skips the report's global sort)."""
    t = tables.transactions.select("account_id", "transaction_id", "transaction_date",
                                   "transaction_ts", "transaction_month", "amount",
                                   "transaction_status")
    # running_sum returns rows sorted by (account, timestamp, id), which is the
    # report order (account, date, time) with a deterministic tie-break.
    out = running_sum(t, "account_id", "amount", "running_total", "account_total_txns",
                      target_rows=target_rows, ordered=ordered)
    return out.select("account_id", "transaction_date", "transaction_month", "amount",
                      "transaction_status", money("running_total").alias("running_total"),
                      "account_total_txns")


def amount_rank(tables: Tables, target_rows: int | None = None, ordered: bool = True) -> DataFrame:
    """3b. RANK of every transaction's amount within its account (largest = 1; ``ordered=False``
    skips the report's global sort)."""
    t = tables.transactions.select("account_id", "transaction_id", "transaction_date",
                                   "amount", "transaction_status")
    # Sorted by (account, rank, id) by rank_desc itself.
    return rank_desc(t, "account_id", "amount", "amount_rank", target_rows=target_rows, ordered=ordered)


def velocity_pairs(tables: Tables, min_minutes: int = S.VELOCITY_MIN_MINUTES,
                   max_minutes: int = S.VELOCITY_MAX_MINUTES, same_day: bool = True,
                   ordered: bool = True) -> DataFrame:
    """3c. Each transaction paired with every earlier one of the same account (and
    day) between ``min_minutes`` and ``max_minutes`` whole minutes before it."""
    pairs = velocity_base(tables.transactions, min_minutes, max_minutes, same_day, extra_cur={})
    out = pairs.select(
        "account_id", "current_txn", "transaction_date", "transaction_time", "current_amount",
        "current_status", "previous_txn", "previous_time", "previous_amount", "minutes_apart")
    if ordered:
        # The range sort samples its input first; shuffling the (usually far
        # smaller) pair output on its own key keeps that sample pass from
        # recomputing the whole fact-sized join.
        out = (out.repartition("account_id", "current_txn", "previous_txn")
                  .orderBy("account_id", "transaction_date", "minutes_apart", "current_txn",
                           "previous_txn"))
    return out


def velocity_base(t: DataFrame, min_minutes: int, max_minutes: int, same_day: bool,
                  extra_cur: dict[str, str]) -> DataFrame:
    """Velocity pairs with the report's column names (unsorted)."""
    cur = {"account_id": "account_id", "transaction_id": "current_txn",
           "transaction_date": "transaction_date", "amount": "current_amount",
           "transaction_status": "current_status", **extra_cur}
    prev = {"transaction_id": "previous_txn", "amount": "previous_amount"}
    pairs = time_window_pairs(t, "account_id", "transaction_ts", "transaction_id",
                              min_minutes, max_minutes,
                              "transaction_date" if same_day else None, cur, prev)
    return pairs.select(*cur.values(), *prev.values(), "minutes_apart",
                        transaction_time("cur_ts").alias("transaction_time"),
                        transaction_time("prev_ts").alias("previous_time"))


def late_night(tables: Tables, first_hour: int = S.LATE_NIGHT_FIRST_HOUR,
               last_hour: int = S.LATE_NIGHT_LAST_HOUR, ordered: bool = True) -> DataFrame:
    """3d. Transactions between ``first_hour`` and ``last_hour`` (inclusive) with
    account and merchant details, largest amount first (``ordered=False`` skips
    the global sort, a shuffle of the whole result, for downstream jobs)."""
    t = (tables.transactions
         .filter(hour_between(first_hour, last_hour, hour_of(tables.transactions)))
         .select("account_id", "merchant_id", "transaction_id", "transaction_date",
                 "transaction_ts", "amount", "transaction_status"))
    a = tables.accounts.select("account_id", "full_name", "risk_tier")
    m = tables.merchants.select("merchant_id", "merchant_name", "merchant_category")
    out = (t.join(bounded_broadcast(a), "account_id", "inner")
            .join(bounded_broadcast(m), "merchant_id", "inner"))
    if ordered:
        # dealt by key first: the sort samples that shuffle, not the scan and the joins again
        out = out.repartition("transaction_id").orderBy(F.col("amount").desc(), "transaction_id")
    return out.select("account_id", "full_name", "risk_tier", "transaction_id",
                      "transaction_date", transaction_time().alias("transaction_time"),
                      "amount", "transaction_status", "merchant_name", "merchant_category")


def _points(col: str, points: dict[str, int]) -> Column:
    expr = None
    for value, p in points.items():
        cond = F.col(col) == F.lit(value)
        expr = F.when(cond, F.lit(p)) if expr is None else expr.when(cond, F.lit(p))
    return F.lit(0) if expr is None else expr.otherwise(F.lit(0))


def risk_scores(tables: Tables, high_value: Decimal | int = S.HIGH_VALUE_AMOUNT,
                weights: tuple[int, int, int] = (S.WEIGHT_FLAGGED, S.WEIGHT_LATE_NIGHT,
                                                 S.WEIGHT_HIGH_VALUE),
                kyc_points: dict[str, int] | None = None,
                status_points: dict[str, int] | None = None,
                cutoffs: tuple[tuple[str, int], ...] = S.RISK_LABELS,
                first_hour: int = S.LATE_NIGHT_FIRST_HOUR,
                last_hour: int = S.LATE_NIGHT_LAST_HOUR, ordered: bool = True) -> DataFrame:
    """3e. Composite risk score and label per account (all accounts, highest first;
    ``ordered=False`` skips the global sort).

    score = w_flag*flagged + w_night*late_night + w_high*(amount > high_value)
            + KYC points + account-status points; label by the first cut-off reached.
    """
    kyc = S.KYC_POINTS if kyc_points is None else kyc_points
    status = S.STATUS_POINTS if status_points is None else status_points
    per_account = (tables.transactions
                   .groupBy("account_id")
                   .agg(F.count("transaction_id").alias("_n"),
                        n_status(S.FLAGGED).alias("_fl"),
                        n_if(hour_between(first_hour, last_hour)).alias("_night"),
                        n_if(F.col("amount") > F.lit(Decimal(high_value))).alias("_high")))
    a = tables.accounts.select("account_id", "full_name", "risk_tier", "kyc_status",
                               "account_status")
    zero = F.lit(0).cast("long")
    scored = (a.join(per_account, "account_id", "left")
               .select("account_id", "full_name", "risk_tier", "kyc_status", "account_status",
                       F.coalesce("_n", zero).alias("total_transactions"),
                       F.coalesce("_fl", zero).alias("flagged_count"),
                       F.coalesce("_night", zero).alias("late_night_txns"),
                       F.coalesce("_high", zero).alias("high_value_txns")))
    score = (F.col("flagged_count") * weights[0] + F.col("late_night_txns") * weights[1]
             + F.col("high_value_txns") * weights[2]
             + _points("kyc_status", kyc) + _points("account_status", status))
    label = None
    for name, cut in cutoffs:
        cond = F.col("composite_risk_score") >= cut
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    label = F.lit(S.RISK_LABEL_DEFAULT) if label is None else label.otherwise(
        F.lit(S.RISK_LABEL_DEFAULT))
    out = (scored
           .withColumn("composite_risk_score", score.cast("long"))
           .withColumn("risk_label", label))
    return out.orderBy(F.col("composite_risk_score").desc(), "account_id") if ordered else out


def category_averages(tables: Tables) -> DataFrame:
    """Mean transaction amount per merchant category (transactions joined to merchants).

    Map-side join and direct category aggregate when merchants are small;
    otherwise aggregated per merchant first, so only merchant-sized rows meet
    the dimension.
    """
    tagged = with_category(tables)
    if tagged is not None:
        return tagged.groupBy("merchant_category").agg(F.avg("amount").alias("avg_amount"))
    m = tables.merchants.select("merchant_id", "merchant_category")
    per_merchant = per_merchant_totals(tables.transactions)
    return (per_merchant.join(m, "merchant_id", "inner")
            .groupBy("merchant_category")
            .agg(decimal_avg(F.sum("sum_amount"), F.sum("n_amount")).alias("avg_amount")))


def above_category_average(tables: Tables, factor: Decimal | float = S.CATEGORY_OUTLIER_FACTOR,
                           ordered: bool = True) -> DataFrame:
    """3f. Transactions above ``factor`` x their merchant category's mean amount,
    largest excess first (``ordered=False`` skips the global sort)."""
    m = tables.merchants.select("merchant_id", "merchant_name", "merchant_category")
    # the means are needed more than once and are few: computed once, sized by themselves
    cats = checkpointed(category_averages(tables))
    # one threshold row per merchant: at most |merchants| rows
    thresholds = m.join(bounded_broadcast(cats), "merchant_category", "inner")
    t = tables.transactions.select("transaction_id", "account_id", "merchant_id", "amount",
                                   "transaction_status")
    k = F.lit(Decimal(str(factor)))
    small = fits_broadcast(tables.merchants)
    if not small and Decimal(str(factor)) > 0:
        # The fact table is about to be shuffled by merchant.  A qualifying row
        # exceeds factor x its category mean, hence factor x the smallest
        # category mean: a scalar that drops most rows before the shuffle.
        t = t.filter(F.col("amount") > cats.agg(F.min("avg_amount")).scalar() * k)
    # thresholds has one row per merchant: the merchants check above bounds it
    joined = t.join(F.broadcast(thresholds) if small else thresholds, "merchant_id", "inner")
    out = (joined
           .filter(F.col("amount") > F.col("avg_amount") * k)
           .select("transaction_id", "account_id", "merchant_name", "merchant_category",
                   "amount", "transaction_status",
                   money("avg_amount").alias("category_avg_amount"),
                   money(F.col("amount") - F.col("avg_amount")).alias("amount_above_avg")))
    if not ordered:
        return out
    return out.repartition("transaction_id").orderBy(F.col("amount_above_avg").desc(), "transaction_id")
