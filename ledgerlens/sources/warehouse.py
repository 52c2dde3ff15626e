"""Model tables in a catalog database, laid out by account.

Transactions, flags and accounts are bucketed on ``account_id`` into the same number of buckets
and sorted inside them.  What groups, orders or joins by account (3a, 3b, 2e, 3e, V2) then reads
each bucket in one task and needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.sources.tables import FILE_BYTES, TABLE_NAMES, Tables, bytes_a_row, with_hour

#: per table: the bucket column and the order inside a bucket
LAYOUT = {
    "accounts": ("account_id", ["account_id"]),
    "merchants": ("merchant_id", ["merchant_id"]),
    "transactions": ("account_id", ["account_id", "transaction_ts", "transaction_id"]),
    "fraud_flags": ("account_id", ["account_id", "flag_id"]),
}


def bucket_count(tables: Tables, file_bytes: int = FILE_BYTES, least: int = 1) -> int:
    """Buckets that hold about ``file_bytes`` of transactions each, as measured."""
    t = with_hour(tables.transactions)
    rows = t.count()
    width = bytes_a_row(t, rows, list(S.CONSTRAINTS["transactions"].primary_key), LAYOUT["transactions"][1])
    return max(least, int(-(-rows * width // file_bytes)))


def save_tables(tables: Tables, database: str, location: str, buckets: int | None = None) -> int:
    """Saves the four tables in ``database`` (its files below ``location``), replacing tables of
    those names; returns the number of buckets.

    Rows are dealt by the bucket column first, so a bucket is one file.
    """
    spark = tables.transactions.sparkSession
    n = bucket_count(tables) if buckets is None else buckets
    root = location.rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}'")
    for name, df in tables.as_dict().items():
        column, order = LAYOUT[name]
        rows = with_hour(df) if name == "transactions" else df
        (rows.repartition(n, column).write.mode("overwrite").option("path", f"{root}/{name}")
         .bucketBy(n, column).sortBy(*order).saveAsTable(f"`{database}`.`{name}`"))
    return n


def open_tables(spark: SparkSession, database: str) -> Tables:
    """The tables of a database by name.

    Names carry their database: the selected one belongs to the whole session, in which other
    reports may run at the same time.
    """
    return Tables(**{name: spark.table(f"`{database}`.`{name}`") for name in TABLE_NAMES})


def exchanges(df) -> int:
    """Shuffles in the physical plan of a frame, joins' broadcasts not counted."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count(
        "Exchange SinglePartition")


def accounts_per_region(spark: SparkSession, database: str):
    """Accounts and their transactions per region and state, by plain SQL over the database's names."""
    return spark.sql(f"""
        SELECT region, state, count(*) AS accounts, coalesce(sum(n), 0) AS transactions, sum(value) AS total_amount
        FROM `{database}`.accounts
        LEFT JOIN (SELECT account_id, count(*) AS n, sum(amount) AS value FROM `{database}`.transactions
                   GROUP BY account_id) USING (account_id)
        GROUP BY region, state""").select("region", "state", "accounts", F.col("transactions").cast("long").alias(
            "transactions"), "total_amount")
