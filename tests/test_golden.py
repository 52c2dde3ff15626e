"""Hand-derived expected values on the edge fixture (see tests/fixture.py)."""

from decimal import Decimal

from ledgerlens.operators import fraud, patterns, volume
from ledgerlens.plans import views


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_velocity_pairs_edges(fixture_tables):
    got = rows(patterns.velocity_pairs(fixture_tables), "current_txn", "previous_txn",
               "minutes_apart")
    # 59 s gap: no pair; 60:59 and 60:00: pairs at 60 minutes; 61:00: no pair;
    # 23:50 -> 00:05 next day: no pair; three within an hour: all three pairs.
    assert sorted(got) == sorted([
        ("T003", "T001", 60), ("T003", "T002", 60), ("T004", "T002", 60),
        ("T008", "T007", 10), ("T009", "T007", 30), ("T009", "T008", 20)])
    # report order: account, date, minutes apart
    assert [g[0] for g in got] == ["T008", "T009", "T009", "T003", "T003", "T004"]


def test_velocity_options(fixture_tables):
    cross = rows(patterns.velocity_pairs(fixture_tables, same_day=False),
                 "current_txn", "previous_txn", "minutes_apart")
    assert ("T006", "T005", 15) in cross and len(cross) == 7
    sub_minute = rows(patterns.velocity_pairs(fixture_tables, min_minutes=0),
                      "current_txn", "previous_txn", "minutes_apart")
    # adds T002<-T001 (59 s), T004<-T003 (1 s), T011<->T010 (0 s, both ways) and the
    # 1 s band-boundary pairs, and T001<-T002 style negative gaps above -60 s
    assert ("T002", "T001", 0) in sub_minute and ("T001", "T002", 0) in sub_minute
    assert ("T010", "T011", 0) in sub_minute and ("T011", "T010", 0) in sub_minute


def test_risk_scores_and_labels(fixture_tables):
    got = {r.account_id: (r.composite_risk_score, r.risk_label)
           for r in patterns.risk_scores(fixture_tables).collect()}
    assert got == {"A01": (0, "Low"), "A02": (35, "Critical"), "A03": (4, "Low"),
                   "A04": (0, "Low"), "A05": (6, "Medium"), "A06": (10, "High"),
                   "A07": (5, "Medium"), "A08": (20, "Critical")}
    first = patterns.risk_scores(fixture_tables).first()
    assert first.account_id == "A02"


def test_high_value_is_strict(fixture_tables):
    got = {r.account_id: r.high_value_txns for r in patterns.risk_scores(fixture_tables).collect()}
    assert got["A02"] == 2        # 150000 and 120000; exactly 100000.00 does not count


def test_account_profile_fan_out_and_nulls(fixture_tables):
    prof = {r.account_id: r for r in views.account_risk_profile(fixture_tables).collect()}
    a2 = prof["A02"]   # 6 transactions x 3 flags
    assert (a2.total_transactions, a2.flagged_count, a2.total_flags) == (18, 12, 18)
    assert a2.total_transaction_value == Decimal("1140000.00")
    assert a2.flagged_amount == Decimal("1119000.00")
    assert (a2.confirmed_fraud_count, a2.under_review_count) == (6, 6)
    a4 = prof["A04"]   # no transactions, two flags
    assert (a4.total_transactions, a4.total_transaction_value, a4.flagged_count) == (0, None, 0)
    assert a4.flagged_amount == Decimal("0.00")
    assert (a4.total_flags, a4.confirmed_fraud_count, a4.under_review_count) == (2, 1, 1)
    a5 = prof["A05"]
    assert (a5.total_transactions, a5.total_flags, a5.total_transaction_value) == (0, 0, None)


def test_account_profile_true_counts(fixture_tables):
    prof = {r.account_id: r for r in views.account_risk_profile(fixture_tables, fan_out=False).collect()}
    a2 = prof["A02"]
    assert (a2.total_transactions, a2.flagged_count, a2.total_flags) == (6, 4, 3)
    assert a2.total_transaction_value == Decimal("380000.00")


def test_high_risk_accounts_having(fixture_tables):
    got = [r.account_id for r in fraud.high_risk_accounts(fixture_tables).collect()]
    assert got == ["A02", "A08"]   # both with flagged transactions; A02 has 6 confirmed


def test_merchant_without_transactions(fixture_tables):
    m = {r.merchant_id: r for r in views.merchant_fraud_profile(fixture_tables).collect()}
    m3 = m["M03"]
    assert (m3.total_transactions, m3.total_transaction_value, m3.avg_transaction_value,
            m3.flagged_count, m3.fraud_rate_pct) == (0, None, None, 0, None)
    m2 = m["M02"]
    assert (m2.total_transactions, m2.flagged_count, m2.fraud_rate_pct) == (6, 4, Decimal("66.67"))


def test_time_bands(fixture_tables):
    t = fixture_tables.transactions
    from ledgerlens.functions.measures import time_band_sort
    got = {r.transaction_id: r.b for r in t.select("transaction_id", time_band_sort().alias("b")).collect()}
    assert [got[k] for k in ("T012", "T013", "T014", "T015", "T016", "T017")] == [1, 2, 2, 3, 3, 4]


def test_amount_rank_ties(fixture_tables):
    got = {r.transaction_id: r.amount_rank for r in patterns.amount_rank(fixture_tables).collect()
           if r.account_id == "A03"}
    assert got == {"T015": 1, "T010": 2, "T011": 2, "T014": 4, "T013": 5, "T012": 6}


def test_running_total_tie_break(fixture_tables):
    got = [(r.amount, r.running_total, r.account_total_txns)
           for r in patterns.running_total(fixture_tables).collect() if r.account_id == "A03"]
    assert [g[1] for g in got] == [Decimal(x) for x in ("700.00", "1400.00", "1700.00", "2100.00",
                                                        "2600.00", "3400.00")]
    assert {g[2] for g in got} == {6}


def test_flag_status_breakdown(fixture_tables):
    got = {r.flag_status: (r.flag_count, r.pct_of_flags, r.resolved_count, r.unresolved_count)
           for r in fraud.flag_status_breakdown(fixture_tables).collect()}
    assert got == {"Confirmed Fraud": (3, Decimal("50.00"), 3, 0),
                   "Under Review": (2, Decimal("33.33"), 0, 2),
                   "False Positive": (1, Decimal("16.67"), 1, 0)}


def test_overall_and_category(fixture_tables):
    o = fraud.overall_fraud_rate(fixture_tables).first()
    # flagged: T001, T002, T003, T006, T020 -> 5 of 21 = 23.81 %;
    # value 150000 + 100000 + 120000 + 3000 + 250000
    assert (o.total_transactions, o.flagged_count, o.fraud_rate_pct) == (21, 5, Decimal("23.81"))
    assert o.total_flagged_amount == Decimal("623000.00")
    cats = {r.merchant_category: r for r in volume.by_merchant_category(fixture_tables).collect()}
    assert set(cats) == {"Retail", "Transfers", "Transport"}   # Food has no transactions
    assert cats["Transfers"].total_transactions == 6


def test_above_category_average(fixture_tables):
    got = [(r.transaction_id, r.category_avg_amount) for r in
           patterns.above_category_average(fixture_tables).collect()]
    # Transport mean = (1500.50+2500+300+400+500+800+200000)/7 = 29428.642857...
    # -> only T019 exceeds 1.5x; Transfers mean 122500 -> T020 (250000) exceeds 183750;
    # Retail mean 9350/8 = 1168.75 -> T006 (3000) and T005 (2000) exceed 1753.125.
    # Ordered by amount above the mean, largest first.
    assert got == [("T019", Decimal("29428.64")), ("T020", Decimal("122500.00")),
                   ("T006", Decimal("1168.75")), ("T005", Decimal("1168.75"))]


def test_late_night(fixture_tables):
    got = [r.transaction_id for r in patterns.late_night(fixture_tables).collect()]
    # amounts 250000, 150000, 120000, 110000, 100000, 5000, 3000, 300, 50
    assert got == ["T020", "T001", "T003", "T021", "T002", "T004", "T006", "T012", "T018"]


def test_unordered_variants_return_the_same_rows(fixture_tables):
    for fn in (patterns.late_night, patterns.risk_scores, patterns.above_category_average,
               patterns.velocity_pairs, fraud.high_risk_accounts):
        a = fn(fixture_tables)
        b = fn(fixture_tables, ordered=False)
        assert sorted(a.collect()) == sorted(b.collect())
        assert "Sort" not in b._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
