"""Plans taken above the broadcast limit give the same results."""

import pytest

from ledgerlens import settings
from ledgerlens.plans import catalog
from tools.compare import diff

SF = "/root/testdata/sf0.001"
NAMES = ["kpi_1d_by_merchant_category", "pat_3d_late_night", "pat_3f_above_category_avg",
         "vw_velocity_events", "dq_foreign_keys"]


@pytest.mark.parametrize("name", NAMES)
def test_shuffle_join_path_matches_broadcast_path(spark, name, monkeypatch):
    small = catalog.run(spark, SF, name).toPandas()
    monkeypatch.setattr(settings, "BROADCAST_MAX_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        big = catalog.run(spark, SF, name)
        got = big.toPandas()
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert diff(got, small) is None, diff(got, small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    

@pytest.mark.parametrize("name", ["kpi_1a_monthly_trend", "pat_3a_running_total",
                                  "pat_3c_velocity_pairs", "dq_primary_keys"])
def test_lazy_and_materialised_bundles_agree(spark, name, monkeypatch):
    materialised = catalog.run(spark, SF, name).toPandas()
    monkeypatch.setattr(catalog.testdata, "materialize", lambda tables, *a: tables)
    monkeypatch.setattr(catalog, "_cache", {})
    lazy = catalog.run(spark, SF, name).toPandas()
    assert diff(lazy, materialised) is None, diff(lazy, materialised)


def test_work_folder_is_decided_once(tmp_path):
    """A session of this process that names no folder has the same one from its first call on, so a
    report does the same work before and after others."""
    import subprocess
    import sys
    code = ("from ledgerlens.session import local_session, work_dir; from ledgerlens.plans import catalog\n"
            "s = local_session(2); a = work_dir(s)\n"
            "n = catalog.run(s, '/root/testdata/sf0.001', 'pat_3f_above_category_avg').count()\n"
            "assert work_dir(s) == a and n > 0; print('same')")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("same"), done.stderr[-2000:]


SKEW_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_hot_account_join_is_split_by_aqe(spark, monkeypatch):
    """Above the broadcast limit a hot account's join partition is split by AQE
    (thresholds scaled down to test size)."""
    from pyspark.sql import functions as F

    from ledgerlens.operators import patterns
    tb = catalog.bundle(spark, "/root/testdata/sf0.01", "orders")
    hot = tb.with_(transactions=tb.transactions.withColumn(
        "account_id", F.when(F.col("transaction_id") % 3 == 0, F.lit(0)).otherwise(F.col("account_id"))))
    expected = patterns.late_night(hot).toPandas()
    monkeypatch.setattr(settings, "BROADCAST_MAX_ROWS", 0)
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        df = patterns.late_night(hot)
        got = df.toPandas()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
        assert diff(got, expected) is None
    finally:
        for k in SKEW_CONF:
            spark.conf.unset(k)
