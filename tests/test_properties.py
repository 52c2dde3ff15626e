"""Property tests: randomised inputs against the naive relational forms."""

from datetime import datetime, timedelta
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.interval import time_window_pairs
from ledgerlens.operators.ordered import rank_desc, running_sum

BASE = datetime(2024, 3, 9, 22, 0, 0)
SLOW = settings(max_examples=12, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])

# gaps chosen near the minute boundaries that matter: 59 s, 60 s, 3599-3661 s, sub-second
offsets = st.one_of(st.integers(0, 2 * 86400),
                    st.sampled_from([0, 59, 60, 61, 3599, 3600, 3659, 3660, 3661, 7200, 86399, 86400]))
events = st.lists(st.tuples(st.sampled_from(["a", "b"]), offsets, st.integers(0, 999_999)),
                  min_size=2, max_size=40)


def _frame(spark, rows):
    data = [(f"t{i}", acc, BASE + timedelta(seconds=s, microseconds=us))
            for i, (acc, s, us) in enumerate(rows)]
    df = spark.createDataFrame(data, "transaction_id string, account_id string, ts timestamp_ntz")
    return df.withColumn("transaction_date", F.to_date("ts"))


@SLOW
@given(rows=events, lo=st.integers(0, 3), span=st.integers(0, 70), same_day=st.booleans())
def test_interval_join_matches_naive(spark, rows, lo, span, same_day):
    t = _frame(spark, rows)
    hi = lo + span
    got = time_window_pairs(t, "account_id", "ts", "transaction_id", lo, hi,
                            "transaction_date" if same_day else None,
                            {"account_id": "account_id", "transaction_id": "cur"},
                            {"transaction_id": "prev"})
    a, b = t.alias("a"), t.alias("b")
    d = F.timestamp_diff("MINUTE", F.col("b.ts"), F.col("a.ts"))
    cond = ((F.col("a.account_id") == F.col("b.account_id"))
            & (F.col("a.transaction_id") != F.col("b.transaction_id")) & d.between(lo, hi))
    if same_day:
        cond = cond & (F.col("a.transaction_date") == F.col("b.transaction_date"))
    naive = a.join(b, cond).select(F.col("a.account_id").alias("account_id"),
                                   F.col("a.transaction_id").alias("cur"),
                                   F.col("b.transaction_id").alias("prev"), d.alias("minutes_apart"))
    got = got.select("account_id", "cur", "prev", "minutes_apart")
    assert sorted(got.collect()) == sorted(naive.collect())


amounts = st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(0, 86400 * 3),
                             st.one_of(st.none(), st.decimals(-500, 500, places=2))),
                   min_size=1, max_size=40)


@SLOW
@given(rows=amounts, target=st.integers(1, 12))
def test_chunked_windows_match_plain(spark, rows, target):
    data = [(f"t{i:03d}", k, BASE + timedelta(seconds=s), v if v is None else Decimal(v))
            for i, (k, s, v) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "transaction_id string, account_id string, transaction_ts timestamp_ntz, amount decimal(12,2)")
    w = Window.partitionBy("account_id")
    plain = df.select("transaction_id",
                      F.sum("amount").over(w.orderBy("transaction_ts", "transaction_id")
                                           .rowsBetween(Window.unboundedPreceding, 0))
                       .cast("decimal(38,2)").alias("rt"),
                      F.count(F.lit(1)).over(w).alias("n"),
                      F.rank().over(w.orderBy(F.col("amount").desc())).cast("long").alias("rk"))
    rs = running_sum(df, "account_id", "amount", "rt", "n", target_rows=target)
    rk = rank_desc(df, "account_id", "amount", "rk", target_rows=target)
    got = rs.select("transaction_id", "rt", "n").join(rk.select("transaction_id", "rk"), "transaction_id")
    assert sorted(got.collect()) == sorted(plain.collect())


statuses = st.sampled_from(["Success", "Flagged", "Failed", "Reversed"])
flag_statuses = st.sampled_from(["Confirmed Fraud", "Under Review", "False Positive"])


@SLOW
@given(tx=st.lists(st.tuples(st.sampled_from(["a1", "a2", "a3", "zz"]), statuses,
                             st.decimals(0, 1000, places=2)), max_size=25),
       fl=st.lists(st.tuples(st.sampled_from(["a1", "a2", "a4", "zz"]), flag_statuses), max_size=12))
def test_fan_out_algebra_matches_exploding_join(spark, tx, fl):
    from ledgerlens.operators.fraud import account_fraud_profile
    from ledgerlens.sources.tables import Tables
    accounts = spark.createDataFrame([(a,) for a in ("a1", "a2", "a3", "a4", "a5")], "account_id string")
    t = spark.createDataFrame([(f"t{i}", a, s, Decimal(v)) for i, (a, s, v) in enumerate(tx)],
                              "transaction_id string, account_id string, transaction_status string, "
                              "amount decimal(12,2)")
    f = spark.createDataFrame([(f"f{i}", a, s) for i, (a, s) in enumerate(fl)],
                              "flag_id string, account_id string, flag_status string")
    tables = Tables(accounts, accounts, t, f)
    got = account_fraud_profile(tables, ["account_id"], fan_out=True)
    # every (transaction, flag) pair of an account as a row, then folded up
    pairs = accounts.join(t, "account_id", "left").join(f, "account_id", "left")
    hit = F.col("transaction_status") == "Flagged"

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    naive = pairs.groupBy("account_id").agg(
        F.count("transaction_id"), F.round(F.sum("amount"), 2), n(hit),
        F.round(F.sum(F.when(hit, F.col("amount")).otherwise(Decimal(0))), 2), F.count("flag_id"),
        n(F.col("flag_status") == "Confirmed Fraud"), n(F.col("flag_status") == "Under Review"))

    def norm(df):
        return sorted(tuple(None if v is None else (float(v) if isinstance(v, Decimal) else v)
                            for v in r) for r in df.collect())
    assert norm(got) == norm(naive)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 5000)), min_size=1, max_size=30))
def test_rate_rounding_matches_decimal_rule(spark, pairs):
    from decimal import ROUND_HALF_UP

    from ledgerlens.functions.measures import rate_pct
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r.r for r in df.select(rate_pct("n", "d").alias("r")).collect()]
    want = []
    for n, d in pairs:
        if d == 0:
            want.append(None)
            continue
        q5 = (Decimal(n * 100) / Decimal(d)).quantize(Decimal("0.00001"), ROUND_HALF_UP)
        want.append(q5.quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert got == want


@SLOW
@given(rows=st.lists(st.tuples(st.sampled_from(["c1", "c2"]), st.integers(0, 6),
                               st.decimals(-99999, 99999, places=2)), min_size=1, max_size=40))
def test_two_level_average_equals_avg(spark, rows):
    from ledgerlens.functions.measures import decimal_avg
    df = spark.createDataFrame([(c, m, Decimal(v)) for c, m, v in rows],
                               "category string, merchant int, amount decimal(12,2)")
    direct = df.groupBy("category").agg(F.avg("amount").alias("a"))
    per_merchant = df.groupBy("category", "merchant").agg(F.sum("amount").alias("s"),
                                                          F.count("amount").alias("n"))
    two_level = per_merchant.groupBy("category").agg(decimal_avg(F.sum("s"), F.sum("n")).alias("a"))
    assert sorted(direct.collect()) == sorted(two_level.collect())


keys = st.one_of(st.none(), st.sampled_from(["k1", "k2", "k3", "k4", "x" * 12]))


@SLOW
@given(acc=st.lists(st.tuples(keys, st.one_of(st.none(), st.text("ab", max_size=3))), max_size=12),
       tx=st.lists(st.tuples(keys, keys), max_size=15))
def test_quality_reports_match_sql(spark, acc, tx):
    from ledgerlens import schema as S
    from ledgerlens.operators import quality
    from ledgerlens.sources.tables import Tables
    a = spark.createDataFrame([(k, n, n, n, "r", "s", "t", "Active", None, "Verified", "Low")
                               for k, n in acc],
                              ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.ACCOUNTS.fields))
    t = spark.createDataFrame([(f"t{i}", acct, "m1") for i, (acct, _) in enumerate(tx)] +
                              [(tid, "k1", "m1") for tid, _ in tx if tid is not None],
                              "transaction_id string, account_id string, merchant_id string")
    m = spark.createDataFrame([("m1",)], "merchant_id string")
    f = spark.createDataFrame([], "flag_id string, transaction_id string, account_id string")
    tables = Tables(a, m, t, f)
    a.createOrReplaceTempView("q_a")
    t.createOrReplaceTempView("q_t")

    pk = {r.table_name: (r.row_count, r.duplicate_keys, r.null_keys)
          for r in quality.primary_key_report(tables).collect()}
    want_a = spark.sql("""SELECT COUNT(*) AS n,
        (SELECT COUNT(*) FROM (SELECT account_id FROM q_a GROUP BY account_id HAVING COUNT(*) > 1)),
        COUNT(*) - COUNT(account_id) FROM q_a""").first()
    assert pk["accounts"] == tuple(want_a)
    want_t = spark.sql("""SELECT COUNT(*),
        (SELECT COUNT(*) FROM (SELECT transaction_id FROM q_t GROUP BY transaction_id HAVING COUNT(*) > 1)),
        COUNT(*) - COUNT(transaction_id) FROM q_t""").first()
    assert pk["transactions"] == tuple(want_t)

    fk = {(r.child_table, r.column_name): r.orphan_rows
          for r in quality.foreign_key_report(tables).collect()}
    orphans = spark.sql("""SELECT COUNT(*) FROM q_t t WHERE t.account_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM q_a a WHERE a.account_id = t.account_id)""").first()[0]
    assert fk[("transactions", "account_id")] == orphans

    nn = {(r.table_name, r.column_name): r.null_count for r in quality.not_null_report(tables).collect()}
    assert nn[("accounts", "full_name")] == sum(1 for _, n in acc if n is None)
    assert nn[("accounts", "registration_date")] == len(acc)
    lim = {(r.table_name, r.column_name): r.violations for r in quality.limits_report(tables).collect()}
    assert lim[("accounts", "account_id")] == sum(1 for k, _ in acc if k is not None and len(k) > 10)
