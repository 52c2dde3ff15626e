"""Data model of the payments-fraud mart: table schemas and fixed domain values.

The four tables are a star: ``transactions`` (fact) references ``accounts`` and
``merchants``; ``fraud_flags`` (second fact) references ``transactions`` and
``accounts``.  Time of day is folded into one ``transaction_ts`` column
(TIMESTAMP_NTZ) at ingest; the report-facing ``transaction_time`` string is derived
from it on output.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Declared table layouts (column order is the positional order of the source rows)
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(12, 2)

ACCOUNTS = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("full_name", T.StringType(), False),
    T.StructField("phone_number", T.StringType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("region", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("account_type", T.StringType(), False),
    T.StructField("account_status", T.StringType(), False),
    T.StructField("registration_date", T.DateType(), False),
    T.StructField("kyc_status", T.StringType(), False),
    T.StructField("risk_tier", T.StringType(), False),
])

MERCHANTS = T.StructType([
    T.StructField("merchant_id", T.StringType(), False),
    T.StructField("merchant_name", T.StringType(), False),
    T.StructField("merchant_category", T.StringType(), False),
    T.StructField("region", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("is_verified", T.ByteType(), False),
])

# Raw layout of a transactions source file: date and time of day are separate.
TRANSACTIONS_RAW = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("account_id", T.StringType(), False),
    T.StructField("merchant_id", T.StringType(), False),
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("transaction_time", T.StringType(), False),
    T.StructField("transaction_month", T.StringType(), False),
    T.StructField("transaction_type", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("transaction_status", T.StringType(), False),
    T.StructField("failure_reason", T.StringType(), True),
    T.StructField("device_type", T.StringType(), False),
])

# Model layout used by every operator: time of day folded into transaction_ts.
TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("account_id", T.StringType(), False),
    T.StructField("merchant_id", T.StringType(), False),
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("transaction_ts", T.TimestampNTZType(), False),
    T.StructField("transaction_month", T.StringType(), False),
    T.StructField("transaction_type", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("transaction_status", T.StringType(), False),
    T.StructField("failure_reason", T.StringType(), True),
    T.StructField("device_type", T.StringType(), False),
])

FRAUD_FLAGS = T.StructType([
    T.StructField("flag_id", T.StringType(), False),
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("account_id", T.StringType(), False),
    T.StructField("flag_date", T.DateType(), False),
    T.StructField("flag_reason", T.StringType(), False),
    T.StructField("flag_status", T.StringType(), False),
    T.StructField("flagged_by", T.StringType(), False),
    T.StructField("resolution_date", T.DateType(), True),
])

# Default namespace (database / folder) holding the four tables.
DEFAULT_DATABASE = "payments"

SCHEMAS = {
    "accounts": ACCOUNTS,
    "merchants": MERCHANTS,
    "transactions": TRANSACTIONS,
    "fraud_flags": FRAUD_FLAGS,
}


@dataclass(frozen=True)
class Constraint:
    """Declared integrity rules of one table (checked by ``operators.quality``)."""

    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # (column, parent table, parent column)
    max_length: dict[str, int] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference model (do not edit)
# ---------------------------------------------------------------------------

# Declared column lengths (VARCHAR(n)) per table.
ACCOUNT_LENGTHS = {"account_id": 10, "full_name": 100, "phone_number": 15, "email": 100,
                   "region": 50, "state": 50, "account_type": 20, "account_status": 20,
                   "kyc_status": 20, "risk_tier": 20}
MERCHANT_LENGTHS = {"merchant_id": 10, "merchant_name": 100, "merchant_category": 50,
                    "region": 50, "state": 50}
TRANSACTION_LENGTHS = {"transaction_id": 15, "account_id": 10, "merchant_id": 10,
                       "transaction_month": 7, "transaction_type": 20, "channel": 20,
                       "transaction_status": 20, "failure_reason": 100, "device_type": 20}
FLAG_LENGTHS = {"flag_id": 15, "transaction_id": 15, "account_id": 10, "flag_reason": 100,
                "flag_status": 20, "flagged_by": 20}

# Transaction status values.
SUCCESS = "Success"
FAILED = "Failed"
FLAGGED = "Flagged"
REVERSED = "Reversed"

# Fraud flag status values.
CONFIRMED_FRAUD = "Confirmed Fraud"
UNDER_REVIEW = "Under Review"
FALSE_POSITIVE = "False Positive"

# Fraud flag reasons (the dash in the velocity reason is U+2014).
REASON_UNUSUAL_AMOUNT = "Unusual Amount"
REASON_LATE_NIGHT = "Late Night Transaction"
REASON_VELOCITY = "Velocity — Multiple Transactions"

# Time-of-day bands: (label, sort key, first hour, last hour), hours inclusive.
TIME_BANDS = (
    ("Late Night (00-04)", 1, 0, 4),
    ("Morning (05-11)", 2, 5, 11),
    ("Afternoon (12-17)", 3, 12, 17),
    ("Evening (18-23)", 4, 18, 23),
)
LATE_NIGHT_FIRST_HOUR = 0
LATE_NIGHT_LAST_HOUR = 4

# Composite risk score (pattern 3e): weights, KYC / status points, label cut-offs.
HIGH_VALUE_AMOUNT = Decimal("100000")
WEIGHT_FLAGGED = 3
WEIGHT_LATE_NIGHT = 2
WEIGHT_HIGH_VALUE = 2
KYC_POINTS = {"Unverified": 5, "Pending": 2}
STATUS_POINTS = {"Suspended": 4}
RISK_LABELS = (("Critical", 20), ("High", 10), ("Medium", 5))
RISK_LABEL_DEFAULT = "Low"

# Velocity pattern (3c / V6): whole elapsed minutes between two transactions.
VELOCITY_MIN_MINUTES = 1
VELOCITY_MAX_MINUTES = 60

# Outlier pattern (3f): factor over the category mean.
CATEGORY_OUTLIER_FACTOR = Decimal("1.5")

# Closed value sets of the columns the reports compare against literals or group by.
DOMAINS = {
    "transactions": {"transaction_status": (SUCCESS, FAILED, FLAGGED, REVERSED)},
    "fraud_flags": {"flag_status": (CONFIRMED_FRAUD, UNDER_REVIEW, FALSE_POSITIVE),
                    "flag_reason": (REASON_UNUSUAL_AMOUNT, REASON_LATE_NIGHT, REASON_VELOCITY),
                    "flagged_by": ("System", "Analyst", "Customer")},
    "accounts": {"kyc_status": ("Verified", "Pending", "Unverified"),
                 "account_status": ("Active", "Suspended", "Closed")},
}

# Merchants are verified unless stated otherwise.
DEFAULT_IS_VERIFIED = 1

CONSTRAINTS = {
    "accounts": Constraint(
        primary_key=("account_id",),
        unique=(("phone_number",), ("email",)),
        not_null=tuple(f.name for f in ACCOUNTS.fields),
        max_length=ACCOUNT_LENGTHS,
    ),
    "merchants": Constraint(
        primary_key=("merchant_id",),
        not_null=tuple(f.name for f in MERCHANTS.fields),
        max_length=MERCHANT_LENGTHS,
        defaults={"is_verified": DEFAULT_IS_VERIFIED},
    ),
    "transactions": Constraint(
        primary_key=("transaction_id",),
        not_null=tuple(f.name for f in TRANSACTIONS.fields if f.name != "failure_reason"),
        foreign_keys=(("account_id", "accounts", "account_id"),
                      ("merchant_id", "merchants", "merchant_id")),
        max_length=TRANSACTION_LENGTHS,
    ),
    "fraud_flags": Constraint(
        primary_key=("flag_id",),
        not_null=tuple(f.name for f in FRAUD_FLAGS.fields if f.name != "resolution_date"),
        foreign_keys=(("transaction_id", "transactions", "transaction_id"),
                      ("account_id", "accounts", "account_id")),
        max_length=FLAG_LENGTHS,
    ),
}
