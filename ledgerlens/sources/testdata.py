"""Adapters from the driver's TPC-H-like test tables to the payments model.

The test folders hold no payment tables, so the model is derived from them with
deterministic rules (one Spark projection per table, no driver-side data):

* accounts      <- customer joined to nation and region
* merchants     <- part
* transactions  <- orders   (``orders_bundle``: 80 months of daily orders)
                or events   (``events_bundle``: dense intra-day event stream)
* fraud_flags   <- the Flagged rows of the chosen transactions

Keys stay BIGINT as stored in the source files.  The rules are fixed; the same
rules are written in DuckDB SQL in ``ledgerlens.plans.oracle``.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.functions.sizing import bounded_broadcast
from ledgerlens.sources.tables import BAD_RECORD, Tables

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# ---------------------------------------------------------------------------
# Fixed derivation rules (must equal the oracle SQL)
# ---------------------------------------------------------------------------
DEVICES_BY_MOD4 = ("Android", "iOS", "POS Terminal", "Web")
EVENT_CHANNELS_BY_MOD5 = ("Mobile", "Web", "USSD", "POS", "ATM")
ORDER_MERCHANTS = 200
REGISTRATION_EPOCH = "2020-01-01"
RESOLUTION_DAYS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    expr = None
    for i, v in enumerate(values[:-1]):
        cond = index == i
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(values[-1])


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    # nation (25 rows) and region (5 rows): broadcast behind the same size check
    n = bounded_broadcast(read(spark, sf_dir, "nation"))
    r = bounded_broadcast(read(spark, sf_dir, "region"))
    k = F.col("c_custkey")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select(
                 k.alias("account_id"),
                 F.col("c_name").alias("full_name"),
                 F.concat(F.lit("080"), F.lpad(k.cast("string"), 8, "0")).alias("phone_number"),
                 F.concat(F.lit("customer"), k.cast("string"), F.lit("@example.com")).alias("email"),
                 F.col("r_name").alias("region"),
                 F.col("n_name").alias("state"),
                 F.col("c_mktsegment").alias("account_type"),
                 F.when(k % 10 == 0, "Suspended").when(k % 10 == 1, "Closed")
                  .otherwise("Active").alias("account_status"),
                 F.date_add(F.lit(REGISTRATION_EPOCH).cast("date"), (k % 1000).cast("int"))
                  .alias("registration_date"),
                 F.when(k % 4 == 0, "Unverified").when(k % 4 == 1, "Pending")
                  .otherwise("Verified").alias("kyc_status"),
                 F.when(k % 3 == 0, "High").when(k % 3 == 1, "Medium")
                  .otherwise("Low").alias("risk_tier"),
             ))


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("merchant_id"),
        F.col("p_name").alias("merchant_name"),
        F.col("p_type").alias("merchant_category"),
        F.col("p_brand").alias("region"),
        F.col("p_brand").alias("state"),
        F.when(F.col("p_size") % 10 == 0, 0).otherwise(1).cast(T.ByteType()).alias("is_verified"),
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "F", S.FLAGGED)
               .when(F.col("o_orderstatus") == "O", S.SUCCESS)
               .when(k % 2 == 0, S.FAILED)
               .otherwise(S.REVERSED))
    return o.select(
        k.alias("transaction_id"),
        F.col("o_custkey").alias("account_id"),
        (k % ORDER_MERCHANTS).alias("merchant_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.timestamp_add("MINUTE", (k * 7919) % 1440, F.col("o_orderdate")).alias("transaction_ts"),
        F.date_format("o_orderdate", "yyyy-MM").alias("transaction_month"),
        F.when(k % 7 == 0, "Transfer").otherwise("Debit").alias("transaction_type"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_totalprice").cast(S.MONEY).alias("amount"),
        status.alias("transaction_status"),
        F.lit(None).cast("string").alias("failure_reason"),
        _pick(k % 4, DEVICES_BY_MOD4).alias("device_type"),
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    et = F.col("event_type")
    status = (F.when(et == "error", S.FLAGGED).when(et == "click", S.FAILED)
               .when(et == "signup", S.REVERSED).otherwise(S.SUCCESS))
    return e.select(
        k.alias("transaction_id"),
        F.col("user_id").alias("account_id"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint").alias("merchant_id"),
        F.col("ts").cast("date").alias("transaction_date"),
        F.col("ts").alias("transaction_ts"),
        F.date_format("ts", "yyyy-MM").alias("transaction_month"),
        F.when(k % 7 == 0, "Transfer").otherwise("Debit").alias("transaction_type"),
        _pick(k % 5, EVENT_CHANNELS_BY_MOD5).alias("channel"),
        F.col("value").cast(S.MONEY).alias("amount"),
        status.alias("transaction_status"),
        F.lit(None).cast("string").alias("failure_reason"),
        _pick(k % 4, DEVICES_BY_MOD4).alias("device_type"),
    )


def flags_from(transactions: DataFrame) -> DataFrame:
    """One fraud flag per Flagged transaction."""
    k = F.col("transaction_id")
    status = (F.when(k % 3 == 0, S.CONFIRMED_FRAUD).when(k % 3 == 1, S.UNDER_REVIEW)
               .otherwise(S.FALSE_POSITIVE))
    return (transactions.filter(F.col("transaction_status") == S.FLAGGED).select(
        k.alias("flag_id"),
        k.alias("transaction_id"),
        F.col("account_id"),
        F.col("transaction_date").alias("flag_date"),
        F.when(k % 7 == 0, S.REASON_VELOCITY).when(k % 7 <= 2, S.REASON_LATE_NIGHT)
         .otherwise(S.REASON_UNUSUAL_AMOUNT).alias("flag_reason"),
        status.alias("flag_status"),
        F.when(k % 5 <= 2, "System").when(k % 5 == 3, "Analyst").otherwise("Customer")
         .alias("flagged_by"),
        F.when(k % 3 == 1, F.lit(None).cast("date"))
         .otherwise(F.date_add("transaction_date", RESOLUTION_DAYS)).alias("resolution_date"),
    ))


def orders_bundle(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR) -> Tables:
    tx = order_transactions(spark, sf_dir)
    return Tables(accounts(spark, sf_dir), merchants(spark, sf_dir), tx, flags_from(tx))


def events_bundle(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR) -> Tables:
    tx = event_transactions(spark, sf_dir)
    return Tables(accounts(spark, sf_dir), merchants(spark, sf_dir), tx, flags_from(tx))


def dirty_bundle(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR) -> Tables:
    """The orders bundle with violations of every declared rule on fixed key residues:
    repeated rows, NULLs, orphan keys, long values, and amounts that DECIMAL(12,2) cannot hold."""
    base = orders_bundle(spark, sf_dir)

    def spoil(df: DataFrame, key: str, repeat: int, **rules: tuple[int, Column]) -> DataFrame:
        k = F.col(key)
        new = {c: F.when(k % mod == 0, bad).otherwise(F.col(c)) for c, (mod, bad) in rules.items()}
        out = df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns], k.alias("_k"))
        return out.union(out.where(F.col("_k") % repeat == 0)).drop("_k")

    null, orphan = F.lit(None).cast("string"), F.lit(-1).cast("bigint")
    amount, k = F.col("amount").cast("decimal(20,3)"), F.col("transaction_id")
    wide = (F.when(k % 43 == 0, amount + F.lit(Decimal("0.005"))).when(k % 47 == 0, amount + F.lit(10 ** 10))
            .otherwise(amount).cast("decimal(20,3)"))
    return Tables(
        spoil(base.accounts, "account_id", 50, risk_tier=(31, null), account_type=(37, F.lit("x" * 25))),
        spoil(base.merchants, "merchant_id", 50, merchant_name=(31, null), region=(37, F.lit("z" * 60))),
        spoil(base.transactions.withColumn("amount", wide), "transaction_id", 53, channel=(59, null),
              device_type=(61, F.lit("y" * 25)), account_id=(41, orphan), merchant_id=(29, orphan)),
        spoil(base.fraud_flags, "flag_id", 11, flagged_by=(17, null), flag_reason=(13, F.lit("y" * 120)),
              transaction_id=(19, orphan), account_id=(23, orphan)))


# ---------------------------------------------------------------------------
# Raw renderings: every column text, bad values on fixed key residues
# ---------------------------------------------------------------------------

def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _raw(df: DataFrame, key: str, mod: int, rules: dict[str, tuple[int, Column]], extra: int) -> DataFrame:
    """Text columns of ``df``; a row whose key leaves the given remainder by ``mod`` gets the bad
    value, and one that leaves ``extra`` a field too many (its whole record in ``BAD_RECORD``)."""
    k = F.col(key).cast("bigint")
    cols = [F.when(k % mod == rules[c][0], rules[c][1]).otherwise(F.col(c)).alias(c) if c in rules
            else F.col(c) for c in df.columns]
    return df.select(*cols, F.when(k % mod == extra, F.lit("one field too many")).alias(BAD_RECORD))


def raw_order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw transactions file: date and time of day separate, amounts as text."""
    t = order_transactions(spark, sf_dir)
    text = _texts(t.select(
        "transaction_id", "account_id", "merchant_id",
        F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"),
        F.date_format("transaction_ts", "HH:mm:ss").alias("transaction_time"),
        "transaction_month", "transaction_type", "channel", "amount",
        "transaction_status", "failure_reason", "device_type"))
    return _raw(text, "transaction_id", 97, {
        "transaction_time": (1, F.lit("25:10:00")), "amount": (2, F.concat("amount", F.lit("5"))),
        "transaction_date": (3, F.lit("not a date")), "channel": (4, F.lit(None).cast("string"))}, extra=5)


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a raw accounts file."""
    return _raw(_texts(accounts(spark, sf_dir)), "account_id", 53, {
        "registration_date": (1, F.lit("2020-13-45")), "risk_tier": (2, F.lit(None).cast("string"))}, extra=3)


def raw_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the orders as a raw fraud_flags file."""
    return _raw(_texts(flags_from(order_transactions(spark, sf_dir))), "flag_id", 89, {
        "flag_date": (1, F.lit("31/12/2024")), "flagged_by": (2, F.lit(None).cast("string")),
        "resolution_date": (3, F.lit("soon"))}, extra=4)


def raw_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts rendered as a raw merchants file without the ``is_verified`` column."""
    m = merchants(spark, sf_dir).drop("is_verified")
    return _raw(_texts(m), "merchant_id", 41, {"merchant_name": (1, F.lit(None).cast("string"))}, extra=-1)


def csv_lines(raw: DataFrame) -> DataFrame:
    """Positional CSV records of a raw frame: quoted fields, NULL bare, one field more where
    ``BAD_RECORD`` is set."""
    fields = [c for c in raw.columns if c != BAD_RECORD]
    quoted = [F.coalesce(F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"')),
                         F.lit("NULL")) for c in fields]
    return raw.select(F.concat_ws(",", *quoted, F.when(F.col(BAD_RECORD).isNotNull(), F.lit('"extra"'))).alias("value"))


#: bytes of given data that one file of the adapted tables holds
FILE_BYTES = 128 << 20


def materialize(tables: Tables, root: str, given_bytes: int, least: int) -> Tables:
    """Write the adapted tables once as typed Parquet under ``root`` and read them back.

    This is the load step: later reports scan typed columns (no per-row casts
    or formatting).  Files follow the size of the given data; the fact tables
    have ``least`` files at least, so that their scans run in parallel.
    ``root`` must be a shared folder.
    """
    out = {}
    by_size = max(1, -(-given_bytes // FILE_BYTES))
    for name, df in tables.as_dict().items():
        path = f"{root}/{name}"
        n = max(by_size, least) if name in ("transactions", "fraud_flags") else by_size
        # hash on the primary key: balanced, and deterministic if a task is retried
        pk = S.CONSTRAINTS[name].primary_key
        df.repartition(n, *pk).write.mode("overwrite").parquet(path)
        out[name] = df.sparkSession.read.parquet(path)
    return Tables(**out)
