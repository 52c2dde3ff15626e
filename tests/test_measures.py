"""Column builders: rounding rules, zero division, DECIMAL averages, time bands."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions.measures import decimal_avg, rate_pct, time_band, time_band_sort


def test_rate_rounds_quotient_to_five_places_first(spark):
    # 951 * 100 / 1001 = 95.0049950...; at 5 places 95.00500, then 95.01
    df = spark.createDataFrame([(951, 1001), (1, 3), (2, 3), (5, 0), (None, 4)], "n long, d long")
    got = [r.r for r in df.select(rate_pct("n", "d").alias("r")).collect()]
    assert got == [Decimal("95.01"), Decimal("33.33"), Decimal("66.67"), None, None]


def test_decimal_avg_equals_avg(spark):
    rows = [(k, Decimal(v)) for k, v in [(1, "10.01"), (1, "10.02"), (1, "10.02"), (2, "0.01"),
                                        (2, "0.02"), (3, "99999999.99"), (3, "0.01")]]
    df = spark.createDataFrame(rows, "k int, amount decimal(12,2)")
    direct = df.groupBy("k").agg(F.avg("amount").alias("a"))
    parts = (df.groupBy("k").agg(F.sum("amount").alias("s"), F.count("amount").alias("n"))
               .select("k", decimal_avg("s", "n").alias("a")))
    assert direct.exceptAll(parts).count() == 0 and parts.exceptAll(direct).count() == 0


def test_time_band_without_else(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 04:59:59' AS transaction_ts UNION ALL "
                   "SELECT timestamp_ntz'2024-01-01 23:00:00' UNION ALL SELECT NULL")
    got = [(r.b, r.s) for r in df.select(time_band().alias("b"), time_band_sort().alias("s")).collect()]
    assert got == [("Late Night (00-04)", 1), ("Evening (18-23)", 4), (None, None)]


def test_counts_on_empty_input(spark, fixture_tables):
    from ledgerlens.operators import fraud, volume
    empty = fixture_tables.with_(transactions=fixture_tables.transactions.limit(0))
    row = fraud.overall_fraud_rate(empty).first()
    # no GROUP BY over no rows: COUNT is 0, SUM(CASE ...) is NULL, the rate NULL
    assert (row.total_transactions, row.flagged_count, row.fraud_rate_pct) == (0, None, None)
    assert volume.monthly_trend(empty).count() == 0
