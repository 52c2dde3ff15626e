"""Typed ingest from text files, quarantine of bad rows, views and marts."""

import csv
import os
from datetime import date

from ledgerlens import schema as S
from ledgerlens.operators import volume
from ledgerlens.plans import views
from ledgerlens.sources.tables import load_table, load_tables, namespace_path, use_database
from tests.fixture import ACCOUNTS, FLAGS, MERCHANTS, TRANSACTIONS


def _write_csv(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        for r in rows:
            w.writerow(["NULL" if v is None else v for v in r])


def _tx_rows(rows):
    return [(r[0], r[1], r[2], r[3].isoformat(), r[4], r[3].strftime("%Y-%m"), *r[5:]) for r in rows]


def test_csv_ingest_quarantines_bad_rows(spark, scratch):
    path = os.path.join(scratch, "csv1", "transactions.csv")
    good = _tx_rows(TRANSACTIONS[:3])
    bad = [
        ("B1", "A01", "M01", "2024-01-01", "25:61:00", "2024-01", "Debit", "Web", "10.00", "Success", None, "Web"),
        ("B2", "A01", "M01", "2024-01-01", "10:00:00", "2024-01", "Debit", "Web", "ten", "Success", None, "Web"),
        ("B3", None, "M01", "2024-01-01", "10:00:00", "2024-01", "Debit", "Web", "10.00", "Success", None, "Web"),
        ("B4", "A01", "M01", "2024-02-30", "10:00:00", "2024-02", "Debit", "Web", "10.00", "Success", None, "Web"),
        ("B5", "A01", "M01", "2024-01-01", "", "2024-01", "Debit", "Web", "10.00", "Success", None, "Web"),
        ("G1", "A01", "M01", "2024-01-01", "9:05:00.5", "2024-01", "Debit", "Web", "10.00", "Success", None, "Web"),
    ]
    _write_csv(path, [f.name for f in S.TRANSACTIONS_RAW.fields], good + bad)
    model, rejected = load_table(spark, path, "transactions", fmt="csv")
    assert model.schema.names == S.TRANSACTIONS.names
    assert sorted(r.transaction_id for r in model.collect()) == ["G1", "T001", "T002", "T003"]
    g1 = [r for r in model.collect() if r.transaction_id == "G1"][0]
    assert str(g1.transaction_ts) == "2024-01-01 09:05:00.500000"
    reasons = {r.transaction_id: r.reject_reason for r in rejected.collect()}
    assert set(reasons) == {"B1", "B2", "B3", "B4", "B5"}
    assert "bad amount" in reasons["B2"] and "null account_id" in reasons["B3"]
    assert reasons["B1"] == "bad transaction_time" and "bad transaction_date" in reasons["B4"]
    t1 = [r for r in model.collect() if r.transaction_id == "T001"][0]
    assert str(t1.transaction_ts) == "2024-01-10 01:00:00" and str(t1.amount) == "150000.00"


def test_load_tables_from_namespace_and_default(spark, scratch):
    base = os.path.join(scratch, "csv2")
    root = namespace_path(base)
    _write_csv(f"{root}/accounts", S.ACCOUNTS.names, ACCOUNTS)
    # merchants file without is_verified: the declared DEFAULT 1 applies
    _write_csv(f"{root}/merchants", S.MERCHANTS.names[:-1], [m[:-1] for m in MERCHANTS])
    _write_csv(f"{root}/transactions", S.TRANSACTIONS_RAW.names, _tx_rows(TRANSACTIONS))
    _write_csv(f"{root}/fraud_flags", S.FRAUD_FLAGS.names, FLAGS)
    tables, rejected = load_tables(spark, base, fmt="csv")
    assert all(df.count() == 0 for df in rejected.values())
    assert tables.transactions.count() == len(TRANSACTIONS)
    assert {r.is_verified for r in tables.merchants.collect()} == {1}
    flags = {r.flag_id: r.resolution_date for r in tables.fraud_flags.collect()}
    assert flags["F02"] is None and flags["F01"] == date(2024, 1, 15)
    assert {r.flag_reason for r in tables.fraud_flags.collect()} >= {S.REASON_VELOCITY}
    assert volume.monthly_trend(tables).count() == 5


def test_canonical_case(spark, scratch):
    path = os.path.join(scratch, "csv3", "transactions.csv")
    rows = _tx_rows(TRANSACTIONS[:2])
    rows[0] = rows[0][:9] + ("flagged ",) + rows[0][10:]
    rows[1] = rows[1][:9] + ("FLAGGED",) + rows[1][10:]
    _write_csv(path, S.TRANSACTIONS_RAW.names, rows)
    plain, _ = load_table(spark, path, "transactions", fmt="csv")
    assert {r.transaction_status for r in plain.collect()} == {"flagged ", "FLAGGED"}
    canon, _ = load_table(spark, path, "transactions", fmt="csv", canonical=True)
    assert {r.transaction_status for r in canon.collect()} == {"Flagged"}


def test_parquet_round_trip(spark, fixture_tables, scratch):
    path = os.path.join(scratch, "pq", "accounts")
    fixture_tables.accounts.write.mode("overwrite").parquet(path)
    model, rejected = load_table(spark, path, "accounts")
    assert rejected.count() == 0 and model.count() == len(ACCOUNTS)
    assert model.schema == S.ACCOUNTS or model.schema.names == S.ACCOUNTS.names


def test_register_views_and_marts(spark, fixture_tables, scratch):
    names = views.register_views(fixture_tables)
    assert set(names) == set(views.VIEWS)
    assert spark.sql("SELECT sum(total_transactions) AS n FROM vw_monthly_fraud_summary").first().n == 21
    out = views.write_marts(fixture_tables, os.path.join(scratch, "marts"))
    monthly = spark.read.parquet(out["vw_monthly_fraud_summary"])
    assert monthly.count() == 5
    assert not any("=" in d for d in os.listdir(out["vw_monthly_fraud_summary"]))       # a row a month
    assert any(d.startswith("transaction_month=") for d in os.listdir(out["vw_time_pattern_analysis"]))
    vel = spark.read.parquet(out["vw_velocity_events"])
    assert vel.count() == 6


def test_register_tables_for_sql(spark, fixture_tables):
    assert views.register_tables(fixture_tables) == ["accounts", "merchants", "transactions",
                                                     "fraud_flags"]
    row = spark.sql("""
        SELECT t.transaction_id, t.transaction_time, a.full_name
        FROM transactions t JOIN accounts a ON t.account_id = a.account_id
        WHERE hour(t.transaction_ts) BETWEEN 0 AND 4 AND t.transaction_status = 'Flagged'
        ORDER BY t.amount DESC LIMIT 1""").first()
    assert (row.transaction_id, row.transaction_time, row.full_name) == ("T020", "01:30:00", "Hauwa Bello")


def test_write_and_load_model_tables(spark, fixture_tables, scratch):
    from ledgerlens.sources import load_tables, write_tables
    from tools.compare import diff
    root = write_tables(fixture_tables, os.path.join(scratch, "model"))
    assert any(d.startswith("transaction_month=") for d in os.listdir(f"{root}/transactions"))
    tables, rejected = load_tables(spark, os.path.join(scratch, "model"))
    assert all(df.count() == 0 for df in rejected.values())
    assert tables.transactions.schema.names == [*S.TRANSACTIONS.names, "transaction_hour"]
    for fn in (volume.monthly_trend, views.velocity_events, views.account_risk_profile):
        assert diff(fn(tables).toPandas(), fn(fixture_tables).toPandas()) is None
    # a month filter reads one partition folder
    plan = tables.transactions.filter("transaction_month = '2024-03'")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-03" in plan


def test_use_database(spark):
    use_database(spark, "ledgerlens_test_db")
    assert spark.catalog.currentDatabase() == "ledgerlens_test_db"
    spark.catalog.setCurrentDatabase("default")


def test_command_line_runner(spark, scratch):
    from ledgerlens.__main__ import main, model_reports
    base = os.path.join(scratch, "cli_in")
    root = namespace_path(base)
    _write_csv(f"{root}/accounts", S.ACCOUNTS.names, ACCOUNTS)
    _write_csv(f"{root}/merchants", S.MERCHANTS.names, MERCHANTS)
    _write_csv(f"{root}/transactions", S.TRANSACTIONS_RAW.names, _tx_rows(TRANSACTIONS))
    _write_csv(f"{root}/fraud_flags", S.FRAUD_FLAGS.names, FLAGS)
    out = os.path.join(scratch, "cli_out")
    written = main(["--input", base, "--format", "csv", "--out", out], spark=spark)
    assert set(written) == set(model_reports())
    assert spark.read.parquet(written["pat_3c_velocity_pairs"]).count() == 6
    assert spark.read.parquet(written["kpi_2a_overall_fraud_rate"]).first().flagged_count == 5
    assert spark.read.parquet(f"{out}/_rejected/transactions").count() == 0
    assert any(d.startswith("transaction_month=")
               for d in os.listdir(f"{out}/_model/payments/transactions"))
    one = main(["--input", base, "--format", "csv", "--out", os.path.join(scratch, "cli_one"),
                "--report", "vw_monthly_fraud_summary"], spark=spark)
    assert list(one) == ["vw_monthly_fraud_summary"]


def test_json_ingest(spark, scratch):
    import json
    path = os.path.join(scratch, "json1", "fraud_flags.json")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        for f in FLAGS:
            rec = dict(zip(S.FRAUD_FLAGS.names, f))
            rec["flag_date"] = rec["flag_date"].isoformat()
            rec["resolution_date"] = rec["resolution_date"].isoformat() if rec["resolution_date"] else None
            fh.write(json.dumps(rec, ensure_ascii=False) + "\n")
        fh.write(json.dumps({"flag_id": "F98", "transaction_id": "T001", "account_id": "A02",
                             "flag_date": "not a date", "flag_reason": "x", "flag_status": "y",
                             "flagged_by": "z"}) + "\n")
    model, rejected = load_table(spark, path, "fraud_flags", fmt="json")
    assert model.count() == len(FLAGS) and model.schema == S.FRAUD_FLAGS or \
        model.schema.names == S.FRAUD_FLAGS.names
    assert {r.flag_reason for r in model.collect()} >= {S.REASON_VELOCITY}
    assert [r.flag_id for r in rejected.collect()] == ["F98"]


def test_positional_csv_without_header(spark, scratch):
    path = os.path.join(scratch, "csv_pos", "merchants.csv")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        for m in MERCHANTS:
            w.writerow(m)
    model, rejected = load_table(spark, path, "merchants", fmt="csv", header="false")
    assert rejected.count() == 0
    got = {r.merchant_id: (r.merchant_category, r.is_verified) for r in model.collect()}
    assert got["M02"] == ("Transfers", 0) and got["M03"] == ("Food", 1)


def _bad_records(spark, scratch, name, fmt, lines):
    path = os.path.join(scratch, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")
    return load_table(spark, path, "transactions", fmt=fmt)


def test_extra_and_missing_fields_and_rounded_amounts_are_rejected(spark, scratch):
    head = ",".join(S.TRANSACTIONS_RAW.names)
    row = "{0},A1,M1,2024-01-05,10:00:00,2024-01,Debit,Web,{1},Success,NULL,Web"
    model, rejected = _bad_records(spark, scratch, "bad1/transactions.csv", "csv", [
        head, row.format("G1", "10.90"), row.format("B1", "10.999"), row.format("B2", "99999999999.00"),
        row.format("B3", "1.00") + ",extra", "B4,A1,M1"])
    assert [r.transaction_id for r in model.collect()] == ["G1"]
    reasons = {r.transaction_id: r.reject_reason for r in rejected.collect()}
    assert reasons["B1"] == reasons["B2"] == "bad amount" and reasons["B3"] == "bad record"
    assert reasons["B4"].startswith("bad record")
    model, rejected = _bad_records(spark, scratch, "bad2/transactions.json", "json", [
        '{"transaction_id": "J1", "account', '{"transaction_id": "J2"}'])
    assert model.count() == 0 and rejected.count() == 2


@__import__("pytest").mark.parametrize("zone,day", [("America/New_York", "2024-03-10"), ("America/Sao_Paulo", "2018-11-04")])
def test_wall_clock_does_not_depend_on_the_session_zone(spark, scratch, zone, day):
    """Times inside the hour that the zone skips (at 2 o'clock, at midnight) stay what they are."""
    hour = "02" if zone.endswith("York") else "00"
    lines = [",".join(S.TRANSACTIONS_RAW.names)]
    for i, t in ((1, f"{hour}:10:00"), (2, f"0{int(hour) + 1}:05:00")):
        lines.append(f"T{i},A1,M1,{day},{t},{day[:7]},Debit,Web,1.00,Success,NULL,Web")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        model, rejected = _bad_records(spark, scratch, f"zone/{zone[-4:]}.csv", "csv", lines)
        got = {r.transaction_id: str(r.transaction_ts) for r in model.collect()}
        assert got == {"T1": f"{day} {hour}:10:00", "T2": f"{day} 0{int(hour) + 1}:05:00"}
        from ledgerlens.operators.interval import time_window_pairs
        pairs = time_window_pairs(model, "account_id", "transaction_ts", "transaction_id", 1, 60, "transaction_date",
                                  {"transaction_id": "cur"}, {"transaction_id": "prev"}).collect()
        assert [(r.cur, r.prev, r.minutes_apart) for r in pairs] == [("T2", "T1", 55)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stored_months_are_clustered(spark, scratch):
    import glob
    from ledgerlens.plans import catalog
    from ledgerlens.sources.tables import write_tables
    tables = catalog.bundle(spark, "/root/testdata/sf0.001", "orders")
    root = write_tables(tables, os.path.join(scratch, "clustered"))
    months = tables.transactions.select("transaction_month").distinct().count()
    assert len(glob.glob(f"{root}/transactions/*/part-*")) == months       # far below a file's target size


def test_adapted_tables_follow_the_given_files(spark, scratch):
    """A given table that changes in a session gives new rows."""
    import shutil
    from ledgerlens.plans import catalog
    folder = os.path.join(scratch, "given")
    os.makedirs(folder)
    for name in catalog.GIVEN:
        shutil.copyfile(f"/root/testdata/sf0.001/{name}.parquet", f"{folder}/{name}.parquet")
    first = catalog.run(spark, folder, "kpi_2a_overall_fraud_rate").first()["total_transactions"]
    half = spark.read.parquet(f"{folder}/orders.parquet").where("o_orderkey % 2 = 0").toPandas()
    half.to_parquet(f"{folder}/orders.parquet", coerce_timestamps="us")
    second = catalog.run(spark, folder, "kpi_2a_overall_fraud_rate").first()["total_transactions"]
    assert second == len(half) < first
