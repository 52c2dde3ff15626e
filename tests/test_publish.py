"""Published versions, files by measured size, the stored hour, and checkpoints of hot rows only."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.sizing import checkpointed
from ledgerlens.operators import patterns
from ledgerlens.operators.ordered import rank_desc, running_sum
from ledgerlens.plans import catalog, views
from ledgerlens.session import folder_bytes, work_dir
from ledgerlens.sources import publish as P
from ledgerlens.sources import tables as tables_module
from ledgerlens.sources.tables import HOUR, load_published, publish_tables, stored_form
from tools.compare import diff

SF = "/root/testdata/sf0.001"


def _texts(df):
    """All columns as text: stored tables have the declared types, the adapted ones integer keys."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).toPandas()


@pytest.fixture(scope="module")
def orders(spark):
    return catalog.bundle(spark, SF, "orders")


def test_a_reader_during_rewrites_sees_whole_versions(spark, scratch):
    """Every version holds one number 1000 times; a reader beside the writer never sees a mixture,
    a part or nothing."""
    path = os.path.join(scratch, "versions")
    P.publish(spark.range(1000).select(F.lit(0).alias("v")), path)
    seen, stop, wrong = set(), threading.Event(), []

    def read():
        while not stop.is_set():
            rows = P.read_published(spark, path).groupBy("v").count().collect()
            if [r["count"] for r in rows] != [1000]:
                wrong.append(rows)
            seen.add(rows[0]["v"])

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 6):
        P.publish(spark.range(1000).repartition(4).select(F.lit(v).alias("v")), path, keep=10)
    stop.set()
    reader.join()
    assert not wrong and seen <= set(range(6)) and P.read_published(spark, path).first()["v"] == 5


def test_an_opened_version_stays_readable_until_it_is_retired(spark, scratch):
    path = os.path.join(scratch, "kept")
    P.publish(spark.range(10), path)
    opened = P.read_published(spark, path)
    P.publish(spark.range(20), path)
    P.publish(spark.range(30), path)
    assert opened.count() == 10 and P.read_published(spark, path).count() == 30
    P.publish(spark.range(40), path)                    # keeps 3: the first one goes
    assert len(P.versions(spark, path)) == 3
    assert len([d for d in os.listdir(path) if d.startswith("data-")]) == 3


def test_a_half_written_version_is_not_seen(spark, scratch):
    path = os.path.join(scratch, "crash")
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, path)
    P.publish(spark.range(3), path)
    spark.range(9).write.parquet(P.new_folder(path)[1])             # written, never switched to
    open(os.path.join(path, "_versions", f"{2:012d}"), "w").close()  # claimed, never filled
    assert P.read_published(spark, path).count() == 3
    assert P.publish(spark.range(4), path).number == 3 and P.read_published(spark, path).count() == 4


def test_a_version_that_comes_while_a_writer_looks_is_kept(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "between")
    P.publish_part(spark.range(10), path, "first")
    name, folder = P.new_folder(path)
    spark.range(10, 20).write.parquet(folder)
    look, seen = P.current, []

    def slow(session, place):
        found = look(session, place)
        if not seen:
            seen.append(found)
            P.publish_part(spark.range(20, 30), path, "between")
        return found

    monkeypatch.setattr(P, "current", slow)
    P.switch(spark, path, name, add=True, tag="last")
    assert P.read_published(spark, path).distinct().count() == 30


def test_two_writers_at_once_both_add(spark, scratch):
    path = os.path.join(scratch, "two")
    threads = [threading.Thread(target=P.publish_part, args=(spark.range(i * 100, i * 100 + 100), path, f"batch-{i}"))
               for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert P.read_published(spark, path).distinct().count() == 400
    assert sorted(P.current(spark, path).tags) == [f"batch-{i}" for i in range(4)]
    P.publish_part(spark.range(100), path, "batch-0")               # the same batch again
    assert P.read_published(spark, path).count() == 400


def test_model_tables_switch_together(spark, orders, scratch):
    base = os.path.join(scratch, "model-versions")
    half = orders.with_(**{n: df.where(F.col(S.CONSTRAINTS[n].primary_key[0]) % 2 == 0)
                           for n, df in orders.as_dict().items()})
    publish_tables(half, base)
    before = load_published(spark, base)
    publish_tables(orders, base)
    after = load_published(spark, base)
    for name, df in orders.as_dict().items():
        assert before.as_dict()[name].count() == half.as_dict()[name].count()
        assert diff(_texts(after.as_dict()[name].select(*df.columns)), _texts(df)) is None


@pytest.mark.parametrize("sf,copies", [("/root/testdata/sf0.01", 1), ("/root/testdata/sf0.01", 20)])
def test_files_follow_the_measured_size(spark, sf, copies, scratch):
    """Files of a month are near the target at two sizes of input."""
    t = catalog.bundle(spark, sf, "orders").transactions.where("transaction_month < '1995-04'")
    t = t.crossJoin(F.broadcast(spark.range(copies).withColumnRenamed("id", "c"))).withColumn(
        "transaction_id", F.col("transaction_id") * copies + F.col("c")).drop("c")
    path, target = os.path.join(scratch, f"sized-{copies}"), 16 << 10
    stored_form("transactions", t, target).write.partitionBy("transaction_month").parquet(path)
    for month in glob.glob(f"{path}/transaction_month=*"):
        sizes = [os.path.getsize(f) for f in glob.glob(f"{month}/part-*.parquet")]
        # as many files as the month's bytes ask for, about evenly filled
        assert len(sizes) <= 2 * sum(sizes) / target + 1
        assert max(sizes) <= 2 * target
    assert spark.read.parquet(path).count() == t.count()


def test_a_group_of_any_size_is_cut(spark, monkeypatch):
    monkeypatch.setattr(tables_module, "MEASURED_ROWS", 500)
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"),
                                  F.sha2(F.col("id").cast("string"), 256).alias("text"))
    dealt = tables_module.by_size(df, "g", ["k"], ["k"], 40 << 10)
    per = dealt.groupBy(F.spark_partition_id().alias("p"), "g").count().collect()
    assert len({r.p for r in per}) == len(per) >= 5                  # no file holds two groups
    assert max(r["count"] for r in per if r.g == "a") < 1200
    assert tables_module.by_size(df.where("false"), "g", ["k"], ["k"], 1).count() == 0


def test_the_hour_filter_reaches_the_files(spark, orders, scratch):
    """3d on stored tables: the filter is pushed down, and sorted row groups outside it are not read."""
    base = os.path.join(scratch, "hours")
    spark.conf.set("parquet.block.size", str(8 << 10))
    try:
        publish_tables(orders.with_(transactions=orders.transactions.withColumn("transaction_month", F.lit("2024-01"))), base)
    finally:
        spark.conf.unset("parquet.block.size")
    loaded = load_published(spark, base)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    got = patterns.late_night(loaded)
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"GreaterThanOrEqual({HOUR},0)" in plan and f"LessThanOrEqual({HOUR},4)" in plan
    assert diff(_texts(got), _texts(patterns.late_night(orders))) is None
    for fn in (views.monthly_fraud_summary, views.time_pattern_analysis):
        assert diff(fn(loaded).drop("transaction_month").toPandas(),
                    fn(orders.with_(transactions=orders.transactions.withColumn("transaction_month", F.lit("2024-01"))))
                    .drop("transaction_month").toPandas()) is None
    import pyarrow.parquet as pq
    groups = kept = 0
    for f in glob.glob(f"{base}/payments/data-*/transactions/*/part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = [meta.row_group(0).column(i).path_in_schema for i in range(meta.num_columns)].index(HOUR)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            groups += 1
            kept += stats.min <= 4
    assert groups >= 4 and kept <= groups / 2


def test_a_wrong_stored_hour_is_rejected(spark, orders, scratch):
    path = os.path.join(scratch, "wronghour")
    t = orders.transactions.withColumn(HOUR, F.when(F.col("transaction_id") % 5 == 0, 99).otherwise(F.hour("transaction_ts")))
    t.write.parquet(path)
    good, bad = tables_module.load_table(spark, path, "transactions")
    assert bad.count() == t.where("transaction_id % 5 = 0").count() and good.count() + bad.count() == t.count()
    assert {r.reject_reason for r in bad.select("reject_reason").distinct().collect()} == {f"bad {HOUR}"}


@pytest.mark.parametrize("which", ["sum", "rank"])
def test_only_hot_rows_are_checkpointed(spark, which):
    """One account with a tenth of the rows costs a checkpoint of about a tenth of the table."""
    t = catalog.bundle(spark, "/root/testdata/sf0.01", "orders").transactions.select(
        "account_id", "transaction_id", "transaction_ts", "amount")
    t = t.withColumn("account_id", F.when(F.col("transaction_id") % 10 == 0, F.lit(-1)).otherwise(F.col("account_id")))

    def stored_by(target):
        before = folder_bytes(spark, work_dir(spark))
        call = {"sum": lambda: running_sum(t, "account_id", "amount", "x", "n", target_rows=target),
                "rank": lambda: rank_desc(t, "account_id", "amount", "x", target_rows=target)}[which]
        df = call()
        return folder_bytes(spark, work_dir(spark)) - before, df

    spent, split = stored_by(500)                        # only the hot account has more
    none, plain = stored_by(10 ** 9)
    before = folder_bytes(spark, work_dir(spark))
    checkpointed(t)
    everything = folder_bytes(spark, work_dir(spark)) - before
    assert none < spent < 0.25 * everything
    rows = [sorted(map(tuple, d.select("transaction_id", "x").collect())) for d in (split, plain)]
    assert rows[0] == rows[1]


def test_windows_without_the_global_sort(spark, orders):
    for fn in (patterns.running_total, patterns.amount_rank):
        for target in (None, 20):
            got = fn(orders, target_rows=target, ordered=False).toPandas()
            assert diff(got, fn(orders).toPandas()) is None


def test_null_keys_are_one_key(spark):
    rows = [(None if i % 2 else i % 3, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, id int, v int")
    for target in (5, 1000):
        got = {r.id: (r.rt, r.n) for r in running_sum(df, "k", "v", "rt", "n", ts="id", tie="id", target_rows=target).collect()}
        assert got[59] == (sum(i for i in range(60) if i % 2), 30)
        ranks = {r.id: r.rk for r in rank_desc(df, "k", "v", "rk", tie="id", target_rows=target).collect()}
        assert ranks[59] == 1 and ranks[1] == 30
