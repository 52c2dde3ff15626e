"""Streaming rules produce the batch reports' rows for in-order arrivals."""

import os

from pyspark.sql import functions as F

from ledgerlens.operators import patterns
from ledgerlens.plans.boundary import normalise
from ledgerlens.streaming import late_night_alerts, read_transactions, start, velocity_alerts
from tools.compare import diff


def _land(fixture_tables, folder):
    # two time-ordered files arriving one after the other: Jan-Feb, then Mar-May
    t = fixture_tables.transactions
    for part in (t.filter(F.col("transaction_month") <= "2024-02"),
                 t.filter(F.col("transaction_month") > "2024-02")):
        part.coalesce(1).sortWithinPartitions("transaction_ts").write.mode("append").parquet(folder)


def test_velocity_stream_matches_batch(spark, fixture_tables, scratch):
    src = os.path.join(scratch, "stream_in_v")
    out = os.path.join(scratch, "stream_out_v")
    _land(fixture_tables, src)
    q = start(velocity_alerts(read_transactions(spark, src, max_files_per_trigger=1)), out)
    assert q.awaitTermination(120) and q.exception() is None
    got = normalise(spark.read.parquet(out)).toPandas()
    want = normalise(patterns.velocity_pairs(fixture_tables, ordered=False)).toPandas()
    assert diff(got, want) is None, diff(got, want)


def test_late_night_stream_matches_batch(spark, fixture_tables, scratch):
    src = os.path.join(scratch, "stream_in_n")
    out = os.path.join(scratch, "stream_out_n")
    _land(fixture_tables, src)
    stream = late_night_alerts(read_transactions(spark, src), fixture_tables.accounts,
                               fixture_tables.merchants)
    q = start(stream, out)
    assert q.awaitTermination(120) and q.exception() is None
    got = normalise(spark.read.parquet(out)).toPandas()
    want = normalise(patterns.late_night(fixture_tables)).toPandas()
    assert diff(got, want) is None, diff(got, want)


def test_velocity_stream_with_late_row(spark, scratch):
    from datetime import date
    from decimal import Decimal

    from ledgerlens import schema as S
    from ledgerlens.sources.tables import fold_time

    def land(rows, folder):
        raw = [(i, a, "M1", date(2024, 7, 1), hhmm, "2024-07", "Debit", "Web", Decimal("1.00"),
                "Success", None, "Web") for i, a, hhmm in rows]
        model, _ = fold_time(spark.createDataFrame(raw, S.TRANSACTIONS_RAW))
        model.coalesce(1).write.mode("append").parquet(folder)

    src = os.path.join(scratch, "stream_in_late")
    out = os.path.join(scratch, "stream_out_late")
    land([("L1", "A", "10:00:00"), ("L2", "A", "10:30:00")], src)
    land([("L3", "A", "10:50:00"), ("L4", "B", "12:00:00")], src)       # watermark -> 11:50
    land([("L5", "A", "10:40:00"), ("L6", "A", "11:52:00")], src)       # L5 arrives late
    q = start(velocity_alerts(read_transactions(spark, src, max_files_per_trigger=1)), out)
    assert q.awaitTermination(120) and q.exception() is None
    got = {(r.current_txn, r.previous_txn) for r in spark.read.parquet(out).collect()}
    batch = {("L2", "L1"), ("L3", "L1"), ("L3", "L2"), ("L5", "L1"), ("L5", "L2"), ("L3", "L5")}
    on_time = {("L2", "L1"), ("L3", "L1"), ("L3", "L2")}
    assert on_time <= got <= batch
