"""Keys at the load, later batches, catalog tables by account, and marts from partial aggregates."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import fraud, patterns
from ledgerlens.plans import catalog, incremental, views
from ledgerlens.sources import loads, publish, warehouse
from ledgerlens.sources.tables import TABLE_NAMES
from tools.compare import diff

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    return catalog.bundle(spark, SF, "orders")


# -------------------------------------------------------------------------------- keys at the load

def test_keys_by_brute_force(spark):
    """Accounts with NULL keys, equal and unequal rows of a key, and shared UNIQUE values."""
    rng = random.Random(5)
    cols = ["account_id", "phone_number", "email"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *"pqrstuvwxyz"]) and rng.choice([None, *map(str, range(60))]),
             f"m{i % 97}") for i in range(150)]
    rows += rows[:20]
    others = [c for c in S.ACCOUNTS.names if c not in cols]
    df = spark.createDataFrame(rows, "account_id long, phone_number string, email string").withColumns(
        {c: F.lit("x") for c in others})
    kept, rejected = loads.enforce_keys(df, "accounts", {})
    got = sorted(map(tuple, kept.select(*cols).collect()), key=str)
    bad = sorted(map(tuple, rejected.select(*cols, "reject_reason").collect()), key=str)

    nulls_first = lambda r: tuple((v is not None, v if v is not None else 0 if i == 0 else "") for i, v in enumerate(r))
    left, out = [], [(*r, "null account_id") for r in rows if r[0] is None]
    live = sorted((r for r in rows if r[0] is not None), key=nulls_first)
    for at, name in ((0, "account_id"), (1, "phone_number"), (2, "email")):
        seen, left = set(), []
        for r in live:
            if r[at] is not None and r[at] in seen:
                out.append((*r, f"duplicate {name}"))
            else:
                seen.add(r[at])
                left.append(r)
        live = left
    assert got == sorted(live, key=str) and bad == sorted(out, key=str)
    assert len(got) + len(bad) == len(rows) and {b[-1] for b in bad} >= {"duplicate phone_number", "null account_id"}


def test_a_flag_of_a_rejected_transaction_is_an_orphan(spark, orders):
    spoiled = orders.with_(transactions=orders.transactions.withColumn(
        "account_id", F.when(F.col("transaction_id") % 7 == 0, F.lit(-1)).otherwise(F.col("account_id"))))
    kept, rejected = loads.enforce_model(spoiled)
    assert set(kept) == set(TABLE_NAMES)
    assert rejected["transactions"].count() == orders.transactions.where("transaction_id % 7 = 0").count()
    lost = {r.transaction_id for r in rejected["fraud_flags"].collect()}
    assert lost == {r.transaction_id for r in orders.fraud_flags.where("transaction_id % 7 = 0").collect()} and lost
    assert kept["transactions"].count() + rejected["transactions"].count() == orders.transactions.count()


# ----------------------------------------------------------------------------------- later batches

def test_a_batch_twice_changes_nothing_and_conflicts_are_set_aside(spark, orders, scratch):
    base = os.path.join(scratch, "batches")
    small = orders.with_(transactions=orders.transactions.where("transaction_id % 2 = 0"),
                         fraud_flags=orders.fraud_flags.where("transaction_id % 2 = 0"))
    loads.load_batch(spark, base, small, "one")
    before = {n: publish.current(spark, f"{base}/payments/{n}") for n in TABLE_NAMES}
    loads.load_batch(spark, base, small, "one")                       # the same tag: nothing is written
    assert before == {n: publish.current(spark, f"{base}/payments/{n}") for n in TABLE_NAMES}
    loads.load_batch(spark, base, small, "one again")                 # the same rows under another tag
    model, bad = loads.loaded_tables(spark, base)
    for n in TABLE_NAMES:
        assert diff(model.as_dict()[n].select(*small.as_dict()[n].columns).toPandas(), small.as_dict()[n].toPandas()) is None
        assert bad[n].count() == 0
    changed = orders.transactions.withColumn("amount", F.when(F.col("transaction_id") % 6 == 0, F.lit(1).cast(S.MONEY))
                                             .otherwise(F.col("amount")))
    stranger = orders.transactions.limit(1).withColumns({"transaction_id": F.lit(10 ** 9).cast("long"),
                                                         "merchant_id": F.lit(-5).cast("long")})
    loads.load_batch(spark, base, orders.with_(transactions=changed.union(stranger)), "two")
    model, bad = loads.loaded_tables(spark, base)
    stored = {r.transaction_id: r.amount for r in model.transactions.collect()}
    for r in orders.transactions.collect():
        # stored rows stay as they were; rows that came new have the batch's amount
        assert stored[r.transaction_id] == (1 if r.transaction_id % 6 == 0 and r.transaction_id % 2 else r.amount)
    assert len(stored) == orders.transactions.count()
    reasons = {r.transaction_id: r.reject_reason for r in bad["transactions"].collect()}
    assert reasons.pop(10 ** 9) == "orphan merchant_id" and set(reasons.values()) == {"duplicate transaction_id"}
    assert set(reasons) == {r.transaction_id for r in small.transactions.where("transaction_id % 6 = 0 and amount <> 1").collect()}


# ---------------------------------------------------------------------------------- catalog tables

def test_reports_by_account_read_catalog_tables_without_an_exchange(spark, scratch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kind in ("orders", "events"):
            tables = catalog.bundle(spark, SF, kind)
            name = f"layout_{kind}"
            assert warehouse.save_tables(tables, name, os.path.join(scratch, name), buckets=4) == 4
            there = warehouse.open_tables(spark, name)
            assert spark.catalog.currentDatabase() == "default"
            assert len([f for f in os.listdir(os.path.join(scratch, name, "transactions")) if f.startswith("part-")]) <= 4
            for fn, params in ((patterns.running_total, {"ordered": False}), (patterns.amount_rank, {"ordered": False}),
                               (patterns.risk_scores, {"ordered": False}), (fraud.high_risk_accounts, {"ordered": False}),
                               (views.account_risk_profile, {})):
                got, plain = fn(there, **params), fn(tables, **params)
                assert warehouse.exchanges(got) == 0, fn.__name__
                assert warehouse.exchanges(plain) > 0
                assert diff(got.toPandas(), plain.toPandas()) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_follow_the_measured_size(orders):
    assert warehouse.bucket_count(orders) == 1
    assert warehouse.bucket_count(orders, file_bytes=4 << 10) > 4


# -------------------------------------------------------------------------------- partial aggregates

@pytest.mark.parametrize("name", list(incremental.REPORTS))
def test_old_and_batch_equal_a_full_run(spark, orders, scratch, name):
    path = os.path.join(scratch, f"parts-{name}")
    full = catalog.BY_NAME[name].fn(orders).toPandas()
    t = orders.transactions
    incremental.add_batch(spark, path, t.where("transaction_id % 5 <> 0"), "old")
    assert diff(incremental.REPORTS[name](incremental.stored(spark, path)).toPandas()[full.columns.tolist()], full) is not None
    for _ in range(2):                                               # the batch a second time changes nothing
        incremental.add_batch(spark, path, t.where("transaction_id % 5 = 0"), "new")
        grown = incremental.REPORTS[name](incremental.stored(spark, path))
        assert diff(grown.toPandas()[full.columns.tolist()], full) is None
    # what the report reads are partials; no file of transactions is among them
    assert not set(grown.inputFiles()) & set(t.inputFiles())


def test_many_parts_are_added_up(spark, orders, scratch, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT_PARTS", 3)
    path = os.path.join(scratch, "parts-many")
    for i in range(6):
        incremental.add_batch(spark, path, orders.transactions.where(F.col("transaction_id") % 6 == i), f"b{i}")
    at = publish.current(spark, path)
    assert len(at.folders) <= 3 and len(at.tags) == 6
    incremental.add_batch(spark, path, orders.transactions, "b3")     # known: not added again
    got = incremental.monthly_trend(incremental.stored(spark, path)).toPandas()
    assert diff(got, catalog.BY_NAME["kpi_1a_monthly_trend"].fn(orders).toPandas()) is None
