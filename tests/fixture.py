"""A small hand-made payments data set covering the edge cases of every report.

Rows are invented for the tests.  Expected values used by ``test_golden.py``
are derived by hand in the comments next to the rows.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from ledgerlens import schema as S
from ledgerlens.sources.tables import Tables, fold_time

D = Decimal

# account_id, full_name, phone, email, region, state, type, status, registered, kyc, tier
ACCOUNTS = [
    ("A01", "Ada Obi", "07000000001", "ada@example.com", "South West", "Lagos", "Savings", "Active", date(2021, 1, 4), "Verified", "Low"),          # score 0
    ("A02", "Bola Ade", "07000000002", "bola@example.com", "South West", "Oyo", "Wallet", "Suspended", date(2022, 2, 1), "Unverified", "High"),     # score 35
    ("A03", "Chi Eze", "07000000003", "chi@example.com", "South East", "Enugu", "Current", "Active", date(2020, 6, 9), "Pending", "Medium"),        # score 4
    ("A04", "Dayo Ojo", "07000000004", "dayo@example.com", "North Central", "Kwara", "Savings", "Closed", date(2023, 3, 3), "Verified", "Low"),     # no txns, 2 flags
    ("A05", "Efe Uko", "07000000005", "efe@example.com", "South South", "Delta", "Wallet", "Suspended", date(2023, 8, 8), "Pending", "Medium"),     # score 6, no txns
    ("A06", "Femi Lawal", "07000000006", "femi@example.com", "South West", "Ogun", "Current", "Suspended", date(2021, 5, 5), "Pending", "Medium"),  # score 10
    ("A07", "Gbenga Uba", "07000000007", "gbenga@example.com", "North West", "Kano", "Savings", "Active", date(2022, 9, 9), "Unverified", "High"),  # score 5
    ("A08", "Hauwa Bello", "07000000008", "hauwa@example.com", "North East", "Borno", "Wallet", "Suspended", date(2024, 1, 2), "Unverified", "High"),  # score 20
]

# merchant_id, name, category, region, state, is_verified
MERCHANTS = [
    ("M01", "Corner Shop", "Retail", "South West", "Lagos", 1),
    ("M02", "Quick Transfer", "Transfers", "South West", "Lagos", 0),
    ("M03", "Food Hut", "Food", "South East", "Enugu", 1),       # no transactions
    ("M04", "Ride Co", "Transport", "South West", "Lagos", 1),
]

# id, account, merchant, date, time, type, channel, amount, status, failure, device
TRANSACTIONS = [
    # A02 velocity edges on 2024-01-10: 59 s gap, 60:59 and 60:00 gaps (pairs), 61:00 (no pair)
    ("T001", "A02", "M02", date(2024, 1, 10), "01:00:00", "Transfer", "Mobile", D("150000.00"), "Flagged", None, "Android"),
    ("T002", "A02", "M02", date(2024, 1, 10), "01:00:59", "Transfer", "Mobile", D("100000.00"), "Flagged", None, "Android"),
    ("T003", "A02", "M02", date(2024, 1, 10), "02:00:59", "Transfer", "Mobile", D("120000.00"), "Flagged", None, "Android"),
    ("T004", "A02", "M02", date(2024, 1, 10), "02:01:00", "Debit", "Mobile", D("5000.00"), "Success", None, "Android"),
    # A02 crossing midnight: 15 minutes apart on different dates, no pair
    ("T005", "A02", "M01", date(2024, 1, 10), "23:50:00", "Debit", "Web", D("2000.00"), "Success", None, "Web"),
    ("T006", "A02", "M01", date(2024, 1, 11), "00:05:00", "Debit", "Web", D("3000.00"), "Flagged", None, "Web"),
    # A01: three within an hour -> three pairs
    ("T007", "A01", "M01", date(2024, 2, 3), "10:00:00", "Debit", "POS", D("1000.00"), "Success", None, "POS Terminal"),
    ("T008", "A01", "M04", date(2024, 2, 3), "10:10:00", "Debit", "Mobile", D("1500.50"), "Success", None, "iOS"),
    ("T009", "A01", "M04", date(2024, 2, 3), "10:30:00", "Debit", "Mobile", D("2500.00"), "Failed", "Insufficient Balance", "iOS"),
    # A03: identical timestamps and amounts (rank tie, running-total tie-break)
    ("T010", "A03", "M01", date(2024, 2, 5), "12:00:00", "Debit", "POS", D("700.00"), "Success", None, "POS Terminal"),
    ("T011", "A03", "M01", date(2024, 2, 5), "12:00:00", "Debit", "POS", D("700.00"), "Reversed", None, "POS Terminal"),
    # time-band boundaries
    ("T012", "A03", "M04", date(2024, 3, 1), "04:59:59", "Debit", "Mobile", D("300.00"), "Success", None, "Android"),
    ("T013", "A03", "M04", date(2024, 3, 1), "05:00:00", "Debit", "Mobile", D("400.00"), "Success", None, "Android"),
    ("T014", "A03", "M04", date(2024, 3, 2), "11:59:59", "Debit", "Mobile", D("500.00"), "Success", None, "Android"),
    ("T015", "A03", "M04", date(2024, 3, 2), "12:00:00", "Debit", "Mobile", D("800.00"), "Success", None, "Android"),
    ("T016", "A01", "M01", date(2024, 3, 3), "17:59:59", "Debit", "Web", D("900.00"), "Success", None, "Web"),
    ("T017", "A01", "M01", date(2024, 3, 3), "18:00:00", "Debit", "Web", D("1000.00"), "Success", None, "Web"),
    # A06: late night + high value -> score exactly 10
    ("T018", "A06", "M01", date(2024, 4, 1), "03:00:00", "Debit", "Mobile", D("50.00"), "Success", None, "Android"),
    ("T019", "A06", "M04", date(2024, 4, 1), "14:00:00", "Debit", "Web", D("200000.00"), "Success", None, "Web"),
    # A08: score exactly 20
    ("T020", "A08", "M02", date(2024, 5, 1), "01:30:00", "Transfer", "Mobile", D("250000.00"), "Flagged", None, "Android"),
    ("T021", "A08", "M02", date(2024, 5, 1), "00:10:00", "Transfer", "Mobile", D("110000.00"), "Success", None, "Android"),
]

# flag_id, transaction, account, date, reason, status, by, resolved
FLAGS = [
    ("F01", "T001", "A02", date(2024, 1, 10), S.REASON_UNUSUAL_AMOUNT, S.CONFIRMED_FRAUD, "System", date(2024, 1, 15)),
    ("F02", "T003", "A02", date(2024, 1, 10), S.REASON_VELOCITY, S.UNDER_REVIEW, "Analyst", None),
    ("F03", "T006", "A02", date(2024, 1, 11), S.REASON_LATE_NIGHT, S.FALSE_POSITIVE, "Customer", date(2024, 1, 20)),
    ("F04", "T007", "A04", date(2024, 2, 3), S.REASON_UNUSUAL_AMOUNT, S.UNDER_REVIEW, "System", None),
    ("F05", "T008", "A04", date(2024, 2, 3), S.REASON_LATE_NIGHT, S.CONFIRMED_FRAUD, "System", date(2024, 2, 10)),
    ("F06", "T020", "A08", date(2024, 5, 1), S.REASON_UNUSUAL_AMOUNT, S.CONFIRMED_FRAUD, "System", date(2024, 5, 5)),
]


def raw_transactions(spark, rows=TRANSACTIONS):
    full = [(r[0], r[1], r[2], r[3], r[4], r[3].strftime("%Y-%m"), *r[5:]) for r in rows]
    return spark.createDataFrame(full, S.TRANSACTIONS_RAW)


def build_tables(spark) -> Tables:
    model, rejected = fold_time(raw_transactions(spark))
    assert rejected.count() == 0
    return Tables(
        accounts=spark.createDataFrame(ACCOUNTS, S.ACCOUNTS),
        merchants=spark.createDataFrame(MERCHANTS, S.MERCHANTS),
        transactions=model,
        fraud_flags=spark.createDataFrame(FLAGS, S.FRAUD_FLAGS),
    )
