"""Catalog of the registered reports: name -> operator and the data it runs on.

Each entry binds one operator to the test-data bundle it is checked on
(``orders``: 80 months of orders as transactions; ``events``: the intra-day
event stream, which is what the velocity and account-fraud reports need).
"""

from __future__ import annotations

import os
import threading
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import fraud, patterns, quality, volume
from ledgerlens.plans import incremental, views
from ledgerlens.plans.boundary import normalise
from ledgerlens.session import app_id, common_dir, delete_at_exit, folder_bytes, listing, owner_id, parallelism
from ledgerlens.sources import loads, testdata, warehouse
from ledgerlens.sources.publish import publish, read_published
from ledgerlens.sources.tables import (
    BAD_RECORD,
    PARTITION_COLUMNS,
    TABLE_NAMES,
    Tables,
    ingest,
    load_published,
    publish_tables,
    read_raw,
    stored_form,
)


@dataclass(frozen=True)
class Report:
    name: str
    fn: Callable[..., DataFrame]
    bundle: str | None = "orders"          # None: fn(spark, sf_dir) reads raw inputs itself
    params: dict = field(default_factory=dict)


#: the given tables that the adapters read
GIVEN = ("customer", "nation", "region", "part", "orders", "events")


def _given(spark: SparkSession, sf_dir: str, kind: str = "orders") -> tuple:
    """The files that the given tables of a bundle are made of now; what is kept in a session is kept
    for exactly these.  Transactions come from orders or from events; the other table may be absent."""
    unread = "orders" if kind == "events" else "events"
    return tuple(listing(spark, f"{sf_dir}/{name}.parquet") for name in GIVEN if name != unread)


def _place(spark: SparkSession, sf_dir: str, given: tuple, kind: str) -> str:
    tag = os.path.basename(os.path.normpath(sf_dir)) or "data"
    digest = zlib.crc32(repr((sf_dir, given)).encode())
    base = f"{common_dir(spark, 'ledgerlens-model')}/{owner_id(spark)}"
    delete_at_exit(spark, base)
    return f"{base}/{tag}-{digest:08x}/{kind}"


_lock = threading.RLock()
_cache: dict[tuple, tuple] = {}


def _once(spark: SparkSession, key: tuple, folder: str, make: Callable[[], object]):
    """What ``make`` returns; it writes to ``folder`` and is called once a key, and again if the
    folder no longer holds the bytes that it wrote (shared folders are cleaned)."""
    with _lock:                       # one load per session even if reports run in threads
        if key not in _cache or folder_bytes(spark, folder) != _cache[key][1]:
            out = make()
            _cache[key] = out, folder_bytes(spark, folder)
        return _cache[key][0]

RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "accounts": testdata.raw_accounts,
    "merchants": testdata.raw_merchants,
    "transactions": testdata.raw_order_transactions,
    "fraud_flags": testdata.raw_flags,
}


def _raw(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A raw-text rendering of a given table, made once for its files.

    It is written as CSV (positional records; merchants with a header, as a column is
    left out) and opened with the file reader.
    """
    given = _given(spark, sf_dir)
    path = _place(spark, sf_dir, given, f"raw/{kind}")

    def make() -> DataFrame:
        df = RAW[kind](spark, sf_dir)
        named = kind == "merchants"
        if named:
            df.drop(BAD_RECORD).write.mode("overwrite").options(header="true", nullValue="NULL").csv(path)
        else:
            testdata.csv_lines(df).write.mode("overwrite").text(path)
        return read_raw(spark, path, kind, fmt="csv", header=str(named).lower())

    return _once(spark, (app_id(spark), sf_dir, f"raw/{kind}", given), path, make)


def ingest_good(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """S3-S6: the raw text of a table through the CSV reader and typed ingest."""
    return ingest(_raw(spark, sf_dir, kind), kind)[0]


def ingest_rejected(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """S7: the rows that ingest rejects, by primary key and reason."""
    rejected = ingest(_raw(spark, sf_dir, kind), kind)[1]
    return rejected.select(*S.CONSTRAINTS[kind].primary_key, "reject_reason")


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8: the model tables and the monthly view published as Parquet, read back, and counted."""
    base = _place(spark, sf_dir, _given(spark, sf_dir), "round-trip")
    publish_tables(bundle(spark, sf_dir, "orders"), base)
    tables = load_published(spark, base)
    views.write_marts(tables, f"{base}/marts", ["vw_monthly_fraud_summary"])
    monthly = views.read_mart(spark, f"{base}/marts", "vw_monthly_fraud_summary")
    stored = tables.transactions.groupBy("transaction_month").agg(
        F.count(F.lit(1)).alias("stored_rows"), F.sum("amount").alias("stored_amount"))
    return monthly.select("transaction_month", "total_transactions", "flagged_count", "fraud_rate_pct").join(
        stored, "transaction_month")


def published_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """S8: all rows of a model table, published over an older version (half of its rows) and read
    back."""
    key = S.CONSTRAINTS[table].primary_key[0]
    base = _place(spark, sf_dir, _given(spark, sf_dir), f"published/{table}")
    df = bundle(spark, sf_dir, "orders").as_dict()[table]
    month = PARTITION_COLUMNS.get(table, [])
    publish(stored_form(table, df.where(F.col(key) % 2 == 0)), base, month)
    publish(stored_form(table, df), base, month)
    return read_published(spark, base).select(*df.columns)


def published_mart(spark: SparkSession, sf_dir: str, name: str, kind: str) -> DataFrame:
    """S8: a view published as a mart over an older version (half of the transactions) and read
    back."""
    base = _place(spark, sf_dir, _given(spark, sf_dir, kind), "published/marts")
    tables = bundle(spark, sf_dir, kind)
    views.write_marts(tables.with_(transactions=tables.transactions.where("transaction_id % 2 = 0")), base, [name])
    views.write_marts(tables, base, [name])
    return views.read_mart(spark, base, name)


def from_catalog(spark: SparkSession, sf_dir: str, fn: Callable[..., DataFrame], kind: str, **params) -> DataFrame:
    """S2: a report on the tables of a catalog database, by name."""
    return fn(warehouse.open_tables(spark, _database(spark, sf_dir, kind)), **params)


def region_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2: plain SQL over the names of a database."""
    return warehouse.accounts_per_region(spark, _database(spark, sf_dir, "orders"))


def _database(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The model tables saved in a database of the session's catalog, once for their files."""
    given = _given(spark, sf_dir, kind)
    place = _place(spark, sf_dir, given, f"catalog-{kind}")

    def make() -> str:
        name = f"payments_{kind}_{zlib.crc32(place.encode()):08x}"
        warehouse.save_tables(bundle(spark, sf_dir, kind), name, place)
        return name

    return _once(spark, (app_id(spark), sf_dir, f"catalog-{kind}", given), place, make)


def key_rejects(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Q1, Q2, Q4 at the load: the rows of a table that leave for a broken key or reference."""
    rejected = loads.enforce_model(bundle(spark, sf_dir, "dirty"), (table,))[1][table]
    return rejected.select(*S.CONSTRAINTS[table].primary_key, "reject_reason")


def _loaded(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the model that :func:`two_loads` reads, loaded once for the given files."""
    given = _given(spark, sf_dir)
    place = _place(spark, sf_dir, given, "loads")

    def make() -> str:
        base = f"{place}/{uuid.uuid4().hex}"
        tables = bundle(spark, sf_dir, "orders")
        even = F.col("transaction_id") % 2 == 0
        other = F.when(F.col("transaction_id") % 20 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(S.MONEY)
        loads.load_batch(spark, base, tables.with_(transactions=tables.transactions.where(even),
                                                   fraud_flags=tables.fraud_flags.where(even)), "first")
        for tag in ("second", "again"):
            loads.load_batch(spark, base, tables.with_(
                transactions=tables.transactions.withColumn("amount", other)), tag)
        return base

    return _once(spark, (app_id(spark), sf_dir, "loads", given), place, make)


def two_loads(spark: SparkSession, sf_dir: str, table: str, rejected: bool) -> DataFrame:
    """S5, S6: a model loaded in two batches, the second one twice.

    The first batch holds all accounts and merchants and the even transactions with their flags;
    the second one everything, with another amount for every twentieth transaction.
    """
    model, bad = loads.loaded_tables(spark, _loaded(spark, sf_dir))
    if rejected:
        return bad[table].select(*S.CONSTRAINTS[table].primary_key, "reject_reason")
    return model.as_dict()[table].select(*S.SCHEMAS[table].names)


def grown_mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A report from partial aggregates that three batches were added to, one of them twice."""
    path = f"{_place(spark, sf_dir, _given(spark, sf_dir), 'partials')}/{uuid.uuid4().hex}"
    t = bundle(spark, sf_dir, "orders").transactions
    for i in (0, 1, 2, 1):
        incremental.add_batch(spark, path, t.where(F.col("transaction_id") % 3 == i), f"batch-{i}")
    return incremental.REPORTS[name](incremental.stored(spark, path))


REPORTS: list[Report] = [
    Report("kpi_1a_monthly_trend", volume.monthly_trend),
    Report("kpi_1b_by_channel", volume.by_channel),
    Report("kpi_1c_by_device", volume.by_device),
    Report("kpi_1d_by_merchant_category", volume.by_merchant_category),
    Report("kpi_2a_overall_fraud_rate", fraud.overall_fraud_rate),
    Report("kpi_2b_flag_status_breakdown", fraud.flag_status_breakdown),
    Report("kpi_2c_by_flag_reason", fraud.by_flag_reason),
    Report("kpi_2d_by_flag_source", fraud.by_flag_source),
    Report("kpi_2e_high_risk_accounts", fraud.high_risk_accounts, "events"),
    Report("kpi_2e_high_risk_accounts_true_counts", fraud.high_risk_accounts, "events",
           {"fan_out": False}),
    Report("pat_3a_running_total", patterns.running_total),
    Report("pat_3b_amount_rank", patterns.amount_rank),
    Report("pat_3c_velocity_pairs", patterns.velocity_pairs, "events"),
    Report("pat_3d_late_night", patterns.late_night),
    Report("pat_3e_risk_scores", patterns.risk_scores),
    Report("pat_3f_above_category_avg", patterns.above_category_average),
    Report("vw_monthly_fraud_summary", views.monthly_fraud_summary),
    Report("vw_account_risk_profile", views.account_risk_profile, "events"),
    Report("vw_account_risk_profile_true_counts", views.account_risk_profile, "events",
           {"fan_out": False}),
    Report("vw_merchant_fraud_profile", views.merchant_fraud_profile),
    Report("vw_channel_device_performance", views.channel_device_performance),
    Report("vw_time_pattern_analysis", views.time_pattern_analysis),
    Report("vw_velocity_events", views.velocity_events, "events"),
    Report("dq_primary_keys", quality.primary_key_report),
    Report("dq_unique", quality.unique_report),
    Report("dq_not_null", quality.not_null_report),
    Report("dq_foreign_keys", quality.foreign_key_report),
    Report("dq_limits", quality.limits_report),
    Report("dq_dirty_primary_keys", quality.primary_key_report, "dirty"),
    Report("dq_dirty_unique", quality.unique_report, "dirty"),
    Report("dq_dirty_not_null", quality.not_null_report, "dirty"),
    Report("dq_dirty_foreign_keys", quality.foreign_key_report, "dirty"),
    Report("dq_dirty_limits", quality.limits_report, "dirty"),
    *(Report(f"src_ingest_{t}", ingest_good, None, {"kind": t}) for t in ("transactions", "merchants", "accounts",
                                                                     "fraud_flags")),
    *(Report(f"src_rejected_{t}", ingest_rejected, None, {"kind": t}) for t in TABLE_NAMES),
    Report("sink_round_trip", model_round_trip, None),
    *(Report(f"sink_table_{t}", published_table, None, {"table": t}) for t in TABLE_NAMES),
    *(Report(f"sink_mart_{v[3:]}", published_mart, None, {"name": v, "kind": k}) for v, k in (
        ("vw_monthly_fraud_summary", "orders"), ("vw_account_risk_profile", "events"),
        ("vw_merchant_fraud_profile", "orders"), ("vw_channel_device_performance", "orders"),
        ("vw_time_pattern_analysis", "orders"), ("vw_velocity_events", "events"))),
    Report("cat_accounts_per_region", region_accounts, None),
    *(Report(f"cat_{n}", from_catalog, None, {"fn": f, "kind": k, "ordered": False}) for n, f, k in (
        ("pat_3a_running_total", patterns.running_total, "orders"), ("pat_3b_amount_rank", patterns.amount_rank, "orders"),
        ("pat_3e_risk_scores", patterns.risk_scores, "orders"),
        ("kpi_2e_high_risk_accounts", fraud.high_risk_accounts, "events"))),
    Report("cat_vw_account_risk_profile", from_catalog, None, {"fn": views.account_risk_profile, "kind": "events"}),
    *(Report(f"src_key_rejects_{t}", key_rejects, None, {"table": t}) for t in TABLE_NAMES),
    Report("load_stored_transactions", two_loads, None, {"table": "transactions", "rejected": False}),
    Report("load_stored_fraud_flags", two_loads, None, {"table": "fraud_flags", "rejected": False}),
    Report("load_rejected_transactions", two_loads, None, {"table": "transactions", "rejected": True}),
    *(Report(f"inc_{n}", grown_mart, None, {"name": n}) for n in incremental.REPORTS),
]

BY_NAME = {r.name: r for r in REPORTS}

_BUNDLES: dict[str, Callable[[SparkSession, str], Tables]] = {
    "orders": testdata.orders_bundle,
    "events": testdata.events_bundle,
    "dirty": testdata.dirty_bundle,
}


def bundle(spark: SparkSession, sf_dir: str, kind: str) -> Tables:
    """The adapted model tables of ``sf_dir``, built once for the files it holds.

    They are written as typed Parquet (the load step), are removed when the session's
    JVM ends, and every report reads them back.  Changed given files give new tables.
    """
    given = _given(spark, sf_dir, kind)
    root = _place(spark, sf_dir, given, kind)

    def make() -> Tables:
        size = sum(f[1] for files in given for f in files)
        return testdata.materialize(_BUNDLES[kind](spark, sf_dir), root, size, parallelism(spark))

    return _once(spark, (app_id(spark), sf_dir, kind, given), root, make)


def run(spark: SparkSession, sf_dir: str, name: str, normalised: bool = True) -> DataFrame:
    """Build report ``name`` over the test data in ``sf_dir`` (lazy)."""
    r = BY_NAME[name]
    if r.bundle is None:
        df = r.fn(spark, sf_dir, **r.params)
    else:
        df = r.fn(bundle(spark, sf_dir, r.bundle), **r.params)
    return normalise(df) if normalised else df
