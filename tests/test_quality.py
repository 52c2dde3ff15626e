"""Constraint checks find each planted violation exactly once."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.operators import quality
from tests.fixture import raw_transactions
from ledgerlens.sources.tables import fold_time


def _nullable(schema):
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


@pytest.fixture(scope="module")
def dirty(spark, fixture_tables):
    acc_bad = spark.createDataFrame([
        ("A01", "Ada Again", "07000000001", "ada@example.com", "South West", "Lagos", "Savings",
         "Active", date(2021, 1, 4), "Verified", "Low"),                      # duplicate key, phone, email
        ("A09", "N" * 101, "07000000009", "long@example.com", "South West", "Lagos", "Savings",
         "Active", date(2021, 1, 4), "Verified", "Low"),                      # name over 100 characters
        ("A10", "No Mail", "07000000010", None, "South West", "Lagos", "Savings",
         "Active", date(2021, 1, 4), "Verified", "Low"),                      # NULL in NOT NULL column
    ], _nullable(S.ACCOUNTS))
    tx_bad, _ = fold_time(raw_transactions(spark, [
        ("T099", "A99", "M01", date(2024, 6, 1), "10:00:00", "Debit", "Web", Decimal("10.00"),
         "Success", None, "Web")]))                                           # orphan account
    fl_bad = spark.createDataFrame([
        ("F99", "T999", "A01", date(2024, 6, 1), S.REASON_UNUSUAL_AMOUNT, S.UNDER_REVIEW,
         "System", None)], _nullable(S.FRAUD_FLAGS))                          # orphan transaction
    return fixture_tables.with_(
        accounts=fixture_tables.accounts.unionByName(acc_bad),
        transactions=fixture_tables.transactions.unionByName(tx_bad),
        fraud_flags=fixture_tables.fraud_flags.unionByName(fl_bad))


def _nonzero(df, key_cols, value_col):
    return {tuple(r[c] for c in key_cols): r[value_col] for r in df.collect() if r[value_col]}


def test_clean_fixture_has_no_violations(fixture_tables):
    assert _nonzero(quality.primary_key_report(fixture_tables), ["table_name"], "duplicate_keys") == {}
    assert _nonzero(quality.not_null_report(fixture_tables), ["table_name", "column_name"], "null_count") == {}
    assert _nonzero(quality.foreign_key_report(fixture_tables), ["child_table", "column_name"], "orphan_rows") == {}
    assert _nonzero(quality.limits_report(fixture_tables), ["table_name", "column_name"], "violations") == {}


def test_primary_key(dirty):
    got = _nonzero(quality.primary_key_report(dirty), ["table_name"], "duplicate_keys")
    assert got == {("accounts",): 1}
    assert quality.duplicate_keys(dirty.accounts, ["account_id"]).collect()[0].occurrences == 2


def test_unique(dirty):
    got = _nonzero(quality.unique_report(dirty), ["table_name", "column_name"], "duplicate_values")
    assert got == {("accounts", "phone_number"): 1, ("accounts", "email"): 1}


def test_not_null(dirty):
    got = _nonzero(quality.not_null_report(dirty), ["table_name", "column_name"], "null_count")
    assert got == {("accounts", "email"): 1}
    assert quality.null_rows(dirty.accounts, ["email"]).count() == 1


def test_foreign_keys(dirty):
    got = _nonzero(quality.foreign_key_report(dirty), ["child_table", "column_name"], "orphan_rows")
    assert got == {("transactions", "account_id"): 1, ("fraud_flags", "transaction_id"): 1}


def test_limits(dirty):
    got = _nonzero(quality.limits_report(dirty), ["table_name", "column_name"], "violations")
    assert got == {("accounts", "full_name"): 1}
    assert quality.too_long(dirty.accounts, S.ACCOUNT_LENGTHS).count() == 1


def test_fill_default(spark):
    df = spark.createDataFrame([("M1", None), ("M2", 0)], "merchant_id string, is_verified int")
    # an explicit NULL is a violation, not an omission
    assert [r.is_verified for r in quality.fill_default(df, "is_verified", 1).orderBy("merchant_id").collect()] == [None, 0]
    absent = quality.fill_default(df.select("merchant_id"), "is_verified", 1)
    assert {r.is_verified for r in absent.collect()} == {1}


def test_every_rule_can_fail(spark):
    """On the spoiled bundle each rule counts violations."""
    from ledgerlens.plans import catalog
    run = lambda name: catalog.run(spark, "/root/testdata/sf0.01", f"dq_dirty_{name}").toPandas()
    pk = run("primary_keys")
    assert (pk["duplicate_keys"] > 0).all()
    assert (run("unique")["duplicate_values"] > 0).all()
    assert (run("foreign_keys")["orphan_rows"] > 0).all()
    assert (run("not_null").groupby("table_name")["null_count"].max() > 0).all()
    limits = run("limits")
    assert (limits.groupby("table_name")["violations"].max() > 0).all()
    assert limits[limits["column_name"] == "amount"]["violations"].iloc[0] > 0


def test_huge_fan_out_does_not_overflow(spark, monkeypatch):
    """10^11 transactions and 10^10 flags of one account: products beyond BIGINT."""
    from decimal import Decimal

    from ledgerlens.operators import fraud
    from ledgerlens.sources.tables import Tables
    a = spark.createDataFrame([("A1",)], "account_id string")
    monkeypatch.setattr(fraud, "per_account_transactions", lambda t: spark.createDataFrame(
        [("A1", 10 ** 11, Decimal("1000.00"), 10 ** 11, Decimal("5.00"))],
        "account_id string, _n long, _sum decimal(22,2), _fl long, _fl_sum decimal(22,2)"))
    monkeypatch.setattr(fraud, "per_account_flags", lambda f: spark.createDataFrame(
        [("A1", 10 ** 10, 10 ** 10, 0)], "account_id string, _m long, _conf long, _rev long"))
    row = fraud.account_fraud_profile(Tables(a, a, a, a), ["account_id"]).first()
    assert row.total_transactions == row.flagged_count == row.total_flags == Decimal(10 ** 21)
    assert row.total_transaction_value == Decimal("1000.00") * 10 ** 10


def test_flagged_accounts_are_chosen_below_the_joins(spark):
    from ledgerlens.operators import fraud
    from ledgerlens.plans import catalog
    tables = catalog.bundle(spark, "/root/testdata/sf0.001", "events")
    plan = fraud.high_risk_accounts(tables, ordered=False)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    first_join = min(i for i, x in enumerate(lines) if "Join " in x)
    rule = [i for i, x in enumerate(lines) if "Filter" in x and "> 0" in x]
    assert rule and min(rule) > first_join
