"""Cross-report invariants on the sf0.01 test data."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import fraud, volume
from ledgerlens.plans import catalog, views

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def orders(spark):
    return catalog.bundle(spark, SF, "orders")


@pytest.fixture(scope="module")
def events(spark):
    return catalog.bundle(spark, SF, "events")


def test_status_counts_sum_to_total(orders):
    bad = volume.monthly_trend(orders).filter(
        F.col("successful") + F.col("failed") + F.col("flagged") + F.col("reversed")
        != F.col("total_transactions"))
    assert bad.count() == 0


def test_bands_sum_to_total(orders):
    v1 = views.monthly_fraud_summary(orders)
    bad = v1.filter(F.col("late_night_txns") + F.col("morning_txns") + F.col("afternoon_txns")
                    + F.col("evening_txns") != F.col("total_transactions"))
    assert bad.count() == 0
    assert v1.filter(F.col("late_night_flagged") > F.col("flagged_count")).count() == 0


def test_flag_shares_sum_to_100(orders):
    total = fraud.flag_status_breakdown(orders).agg(F.sum("pct_of_flags")).first()[0]
    assert abs(float(total) - 100.0) <= 0.02


def test_channel_device_rolls_up_to_channel(orders):
    v4 = (views.channel_device_performance(orders).groupBy("channel")
          .agg(F.sum("total_transactions").alias("n"), F.sum("total_amount").alias("amt"),
               F.sum("flagged").alias("fl")))
    b = volume.by_channel(orders).select("channel", F.col("total_transactions").alias("n"),
                                         F.col("total_amount").alias("amt"),
                                         F.col("flagged_count").alias("fl"))
    assert v4.exceptAll(b).count() == 0 and b.exceptAll(v4).count() == 0


def test_time_pattern_rolls_up_to_month(orders):
    v5 = (views.time_pattern_analysis(orders).groupBy("transaction_month")
          .agg(F.sum("total_transactions").alias("n"), F.sum("flagged_count").alias("fl"),
               F.sum("flagged_amount").alias("fa")))
    v1 = views.monthly_fraud_summary(orders).select(
        "transaction_month", F.col("total_transactions").alias("n"),
        F.col("flagged_count").alias("fl"), F.col("flagged_amount").alias("fa"))
    assert v5.exceptAll(v1).count() == 0 and v1.exceptAll(v5).count() == 0


def test_fan_out_equals_exploding_join(events):
    a, t, f = events.accounts, events.transactions, events.fraud_flags
    naive = (a.join(t, "account_id", "left").join(f.select("account_id", "flag_id", "flag_status"),
                                                  "account_id", "left")
             .groupBy("account_id")
             .agg(F.count("transaction_id").alias("total_transactions"),
                  F.sum(F.when(F.col("transaction_status") == "Flagged", 1).otherwise(0)).alias("flagged_count"),
                  F.count("flag_id").alias("total_flags"),
                  F.sum(F.when(F.col("flag_status") == "Confirmed Fraud", 1).otherwise(0)).alias("confirmed_fraud_count"),
                  F.sum("amount").alias("total_transaction_value")))
    got = fraud.account_fraud_profile(events, ["account_id"]).select(
        "account_id", "total_transactions", "flagged_count", "total_flags",
        "confirmed_fraud_count", F.col("total_transaction_value").cast("decimal(38,2)"))
    naive = naive.withColumn("total_transaction_value", F.col("total_transaction_value").cast("decimal(38,2)"))
    assert got.exceptAll(naive).count() == 0 and naive.exceptAll(got).count() == 0


def test_true_counts_match_sources(events):
    prof = views.account_risk_profile(events, fan_out=False).agg(
        F.sum("total_transactions"), F.sum("total_flags")).first()
    assert prof[0] == events.transactions.count()
    assert prof[1] == events.fraud_flags.count()
