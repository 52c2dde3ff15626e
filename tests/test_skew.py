"""Skew-safe operators equal their naive forms, also when hot keys are split."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.interval import time_window_pairs
from ledgerlens.operators.ordered import rank_desc, running_sum
from ledgerlens.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def orders_tx(spark):
    return catalog.bundle(spark, SF, "orders").transactions


@pytest.fixture(scope="module")
def few_orders(spark):
    return catalog.bundle(spark, "/root/testdata/sf0.001", "orders").transactions


@pytest.fixture(scope="module")
def events_tx(spark):
    return catalog.bundle(spark, SF, "events").transactions


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("target", [9, 60, 1_000_000])
def test_running_sum_equals_window(few_orders, target):
    t = few_orders.select("account_id", "transaction_id", "transaction_ts", "amount")
    w = Window.partitionBy("account_id").orderBy("transaction_ts", "transaction_id")
    naive = t.select("account_id", "transaction_id",
                     F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0))
                      .cast("decimal(38,2)").alias("rt"),
                     F.count(F.lit(1)).over(Window.partitionBy("account_id")).alias("n"))
    got = running_sum(t, "account_id", "amount", "rt", "n", target_rows=target)
    assert _same(got.select("account_id", "transaction_id", "rt", "n"), naive)
    order = [(r.account_id, r.transaction_id) for r in got.select("account_id", "transaction_id").collect()]
    want = [(r.account_id, r.transaction_id) for r in
            t.orderBy("account_id", "transaction_ts", "transaction_id").collect()]
    assert order == want


@pytest.mark.parametrize("target", [9, 60, 1_000_000])
def test_rank_equals_window(few_orders, target):
    t = few_orders.select("account_id", "transaction_id", "amount")
    naive = t.select("account_id", "transaction_id", F.rank().over(
        Window.partitionBy("account_id").orderBy(F.col("amount").desc())).alias("rk"))
    got = rank_desc(t, "account_id", "amount", "rk", target_rows=target)
    assert _same(got.select("account_id", "transaction_id", "rk"), naive)
    keys = [(r.account_id, r.rk, r.transaction_id) for r in got.collect()]
    assert keys == sorted(keys)


def test_rank_with_nulls_and_one_hot_key(spark):
    rows = [("hot", i, float(i % 5) if i % 7 else None) for i in range(60)] + [("cold", 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    naive = df.select("k", "id", F.rank().over(Window.partitionBy("k").orderBy(F.col("v").desc()))
                      .alias("rk"))
    got = rank_desc(df, "k", "v", "rk", tie="id", target_rows=7)
    assert _same(got.select("k", "id", "rk"), naive)


@pytest.mark.parametrize("min_m,max_m,same_day", [(1, 60, True), (1, 60, False), (0, 60, True),
                                                 (5, 10, True), (0, 0, False)])
def test_interval_join_equals_naive(events_tx, min_m, max_m, same_day):
    t = events_tx.select("account_id", "transaction_id", "transaction_ts", "transaction_date")
    got = time_window_pairs(t, "account_id", "transaction_ts", "transaction_id", min_m, max_m,
                            "transaction_date" if same_day else None,
                            {"account_id": "account_id", "transaction_id": "cur"},
                            {"transaction_id": "prev"})
    a, b = t.alias("a"), t.alias("b")
    d = F.timestamp_diff("MINUTE", F.col("b.transaction_ts"), F.col("a.transaction_ts"))
    cond = ((F.col("a.account_id") == F.col("b.account_id"))
            & (F.col("a.transaction_id") != F.col("b.transaction_id")) & d.between(min_m, max_m))
    if same_day:
        cond = cond & (F.col("a.transaction_date") == F.col("b.transaction_date"))
    naive = a.join(b, cond).select(F.col("a.account_id").alias("account_id"),
                                   F.col("a.transaction_id").alias("cur"),
                                   F.col("b.transaction_id").alias("prev"), d.alias("minutes_apart"))
    assert _same(got.select("account_id", "cur", "prev", "minutes_apart"), naive)
    assert got.count() > 0


def test_interval_join_rejects_bad_range(events_tx):
    with pytest.raises(ValueError):
        time_window_pairs(events_tx, "account_id", "transaction_ts", "transaction_id", 5, 1,
                          None, {}, {})


def _one_hot_account(orders_tx):
    # a third of all transactions moved onto account 0
    return orders_tx.withColumn(
        "account_id", F.when(F.col("transaction_id") % 3 == 0, F.lit(0)).otherwise(F.col("account_id")))


@pytest.fixture
def no_coalesce(spark):
    # at test sizes AQE would merge all partitions into one and hide the spread
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_account_is_spread_over_tasks(spark, orders_tx, no_coalesce):
    t = _one_hot_account(orders_tx).select("account_id", "transaction_id", "transaction_ts", "amount")
    hot_rows = t.filter("account_id = 0").count()
    assert hot_rows * 3 >= t.count() - 3
    got = running_sum(t, "account_id", "amount", "rt", "n", target_rows=hot_rows // 8)
    spread = (got.filter("account_id = 0").select(F.spark_partition_id().alias("p"))
                 .distinct().count())
    assert spread >= 4
    w = Window.partitionBy("account_id").orderBy("transaction_ts", "transaction_id")
    naive = t.select("account_id", "transaction_id",
                     F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0))
                      .cast("decimal(38,2)").alias("rt"))
    assert _same(got.select("account_id", "transaction_id", "rt"), naive)
    ranked = rank_desc(t, "account_id", "amount", "rk", target_rows=hot_rows // 8)
    assert ranked.filter("account_id = 0").select(F.spark_partition_id()).distinct().count() >= 4
    # the plain window keeps the hot account in one partition
    plain = t.repartitionByRange("account_id").withColumn("rt", F.sum("amount").over(w))
    assert plain.filter("account_id = 0").select(F.spark_partition_id()).distinct().count() == 1


def test_hot_account_velocity_is_spread(spark, events_tx, no_coalesce):
    t = events_tx.withColumn(
        "account_id", F.when(F.col("transaction_id") % 3 == 0, F.lit(0)).otherwise(F.col("account_id")))
    t = t.select("account_id", "transaction_id", "transaction_ts", "transaction_date")
    got = time_window_pairs(t, "account_id", "transaction_ts", "transaction_id", 1, 60,
                            "transaction_date", {"account_id": "account_id", "transaction_id": "cur"},
                            {"transaction_id": "prev"})
    hot = got.filter("account_id = 0")
    assert hot.select(F.spark_partition_id()).distinct().count() >= 4
    a, b = t.alias("a"), t.alias("b")
    d = F.timestamp_diff("MINUTE", F.col("b.transaction_ts"), F.col("a.transaction_ts"))
    naive = a.join(b, (F.col("a.account_id") == F.col("b.account_id"))
                   & (F.col("a.transaction_date") == F.col("b.transaction_date"))
                   & (F.col("a.transaction_id") != F.col("b.transaction_id")) & d.between(1, 60))
    assert hot.count() == naive.filter("a.account_id = 0").count() > 0


def test_rows_that_arrive_later_are_counted(spark, orders_tx, scratch, no_coalesce):
    import os
    path = os.path.join(scratch, "grow")
    t = _one_hot_account(orders_tx).select("account_id", "transaction_id", "transaction_ts", "amount")
    t.filter("transaction_id % 2 = 0").write.mode("overwrite").parquet(path)
    first = spark.read.parquet(path)
    running_sum(first, "account_id", "amount", "rt", "n", target_rows=500).count()
    rank_desc(first, "account_id", "amount", "rk", target_rows=500).count()
    # new rows arrive in the same folder
    t.filter("transaction_id % 2 = 1").write.mode("append").parquet(path)
    grown = spark.read.parquet(path)
    w = Window.partitionBy("account_id")
    naive = grown.select("account_id", "transaction_id",
                         F.sum("amount").over(w.orderBy("transaction_ts", "transaction_id")
                                              .rowsBetween(Window.unboundedPreceding, 0))
                          .cast("decimal(38,2)").alias("rt"),
                         F.count(F.lit(1)).over(w).alias("n"))
    got = running_sum(grown, "account_id", "amount", "rt", "n", target_rows=500)
    assert _same(got.select("account_id", "transaction_id", "rt", "n"), naive)
    naive_rk = grown.select("account_id", "transaction_id", F.rank().over(
        w.orderBy(F.col("amount").desc())).cast("long").alias("rk"))
    got_rk = rank_desc(grown, "account_id", "amount", "rk", target_rows=500)
    assert _same(got_rk.select("account_id", "transaction_id", "rk"), naive_rk)


def test_rank_with_negative_and_zero_amounts(spark):
    vals = [-1000.5, -3.0, -3.0, -0.01, 0.0, 0.0, 0.01, 2.5, 2.5, 99999.99, None]
    rows = [("hot", i, vals[i % len(vals)]) for i in range(200)] + [("cold", 1, -1.0), ("cold", 2, 1.0)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    naive = df.select("k", "id", F.rank().over(Window.partitionBy("k").orderBy(F.col("v").desc()))
                      .cast("long").alias("rk"))
    for target in (5, 17, 1000):
        got = rank_desc(df, "k", "v", "rk", tie="id", target_rows=target)
        assert _same(got.select("k", "id", "rk"), naive)


def _chunk_sizes(df, target, *order):
    from ledgerlens.operators import ordered
    rows = ordered._hot_keys(df, "k", target)[1]
    chunks = ordered._chunked(df, rows, target, F.col("k"), *order)
    return [r["n"] for r in chunks.groupBy("k", ordered._CHUNK).agg(F.count("*").alias("n")).collect()]


def test_an_old_outlier_does_not_unbalance_chunks(spark):
    """100,000 rows of one account, one of 2004 and the rest on one day."""
    df = spark.range(100_000).select(
        F.lit("hot").alias("k"), "id", (F.col("id") % 100).cast("decimal(12,2)").alias("amount"),
        F.when(F.col("id") == 0, F.lit("2004-01-01 00:00:00")).otherwise(F.lit("2024-05-01 00:00:00"))
        .cast("timestamp_ntz").alias("ts0")).withColumn(
            "ts", F.timestamp_add("SECOND", (F.col("id") % 3600).cast("int"), F.col("ts0"))).drop("ts0")
    sizes = _chunk_sizes(df, 2000, F.col("ts"), F.col("id"))
    assert sum(sizes) == 100_000 and max(sizes) <= 4000
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    naive = df.select("id", F.sum("amount").over(w).cast("decimal(38,2)").alias("rt"))
    got = running_sum(df, "k", "amount", "rt", "n", ts="ts", tie="id", target_rows=2000)
    assert _same(got.select("id", "rt"), naive)


def test_one_repeated_amount_is_split(spark):
    """100,000 rows of one account, 90 % of one amount."""
    df = spark.range(100_000).select(
        F.lit("hot").alias("k"), "id",
        F.when(F.col("id") % 10 == 0, F.col("id") % 977).otherwise(500).cast("decimal(12,2)").alias("amount"))
    sizes = _chunk_sizes(df, 2000, F.col("amount").desc(), F.col("id"))
    assert sum(sizes) == 100_000 and max(sizes) <= 4000
    naive = df.select("id", F.rank().over(Window.partitionBy("k").orderBy(F.col("amount").desc())).cast("long").alias("rk"))
    got = rank_desc(df, "k", "amount", "rk", tie="id", target_rows=2000)
    assert _same(got.select("id", "rk"), naive)
