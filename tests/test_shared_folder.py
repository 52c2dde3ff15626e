"""Sessions that share one folder for intermediate tables."""

import os
import stat
import subprocess
import sys
from datetime import datetime, timedelta

import pytest

from ledgerlens import session
from ledgerlens.functions.sizing import checkpointed
from ledgerlens.plans import catalog
from ledgerlens.session import app_id, delete_path, file_names, owner_id, work_dir

START = datetime(2024, 1, 1)


def given_tables(spark, folder, leave_out=()):
    """Small given tables of the adapters' columns."""
    rows = {
        "region": ([(0, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"N{n}", 0) for n in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"c{k}", k % 3, 1.0, "BUILDING") for k in range(12)],
                     "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(k, f"p{k}", "Brand#1", "TIN", k, 2.0) for k in range(200)],
                 "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(k, k % 12, "FOP"[k % 3], 10.0 + k, START + timedelta(days=k), f"{k % 5}-X") for k in range(90)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                   "o_orderdate timestamp_ntz, o_orderpriority string"),
        "events": ([(k, START + timedelta(minutes=k), k % 12, ("error", "click", "view")[k % 3], 1.0 + k, f'{{"p": {k % 200}}}')
                    for k in range(60)],
                   "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
    }
    for name, (values, schema) in rows.items():
        if name not in leave_out:
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_sessions_with_one_application_id_keep_their_own_tables(spark, tmp_path):
    """Masters give out one id to applications that start in the same second; each of them still
    writes and reads its own tables of the shared folder."""
    folder = given_tables(spark, tmp_path)
    names = ["kpi_1a_monthly_trend", "dq_not_null", "cat_kpi_2e_high_risk_accounts"]
    frames = {n: catalog.run(spark, folder, n) for n in names}
    code = ("import sys; from ledgerlens.plans import catalog; from ledgerlens.session import app_id, local_session\n"
            "app, shared, folder, *names = sys.argv[1:]\n"
            "s = local_session(2, extra={'spark.test.appId': app, 'spark.checkpoint.dir': shared, 'spark.driver.memory': '1g'})\n"
            "assert app_id(s) == app\n"
            "print(*(catalog.run(s, folder, n).count() for n in names)); s.stop()")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, app_id(spark), work_dir(spark), folder, *names], text=True,
                          cwd=here, capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = [len(frames[n].collect()) for n in names]          # its files are the session's own
    assert counts == list(map(int, done.stdout.split()[-len(names):])) and all(counts)


def test_reports_need_only_the_tables_of_their_bundle(spark, tmp_path):
    """Reports on orders run without events, those on events without orders."""
    whole = given_tables(spark, tmp_path / "whole")
    for unread, names in (("events", ["kpi_1a_monthly_trend", "dq_dirty_limits"]), ("orders", ["cat_kpi_2e_high_risk_accounts"])):
        folder = given_tables(spark, tmp_path / f"no-{unread}", leave_out=(unread,))
        for name in names:
            some, all_ = (sorted(map(str, catalog.run(spark, d, name).collect())) for d in (folder, whole))
            assert some == all_ and some


def test_reports_outlive_a_cleaned_shared_folder(spark, tmp_path):
    """Tables that a session keeps are made again when what they wrote is gone."""
    folder = given_tables(spark, tmp_path)
    names = ["kpi_1a_monthly_trend", "dq_dirty_limits", "cat_pat_3a_running_total", "src_rejected_accounts"]
    first = {n: sorted(map(str, catalog.run(spark, folder, n).collect())) for n in names}
    delete_path(spark, f"{work_dir(spark)}/ledgerlens-model/{owner_id(spark)}")
    assert {n: sorted(map(str, catalog.run(spark, folder, n).collect())) for n in names} == first


@pytest.fixture
def on_cluster(monkeypatch):
    """The session's master counts as one of other machines; gives the folders tried."""
    monkeypatch.setattr(session, "sc_is_remote", lambda spark: True)
    monkeypatch.setattr(session, "_tried", tried := set(), raising=False)
    return tried


def test_a_mounted_folder_serves_a_cluster(spark, tmp_path, on_cluster):
    """A path of the local file system may be shared by all machines: it is tried, once, not refused by name."""
    names = ["kpi_1a_monthly_trend", "dq_dirty_limits"]
    folder = given_tables(spark, tmp_path)
    assert all(catalog.run(spark, folder, n).count() for n in names)
    assert checkpointed(spark.range(7)).count() == 7 and len(on_cluster) == 1
    assert not [n for n in file_names(spark, work_dir(spark)) if n.startswith("ledgerlens-trial")]


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, on_cluster, monkeypatch):
    """Files of other executors are missing there; nothing is stored in it."""
    writer = type(spark.range(1).write)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **b: write(self._df.where("id > 0").write, path, *a, **b))
    for _ in range(2):
        with pytest.raises(RuntimeError, match="folder of one machine"):
            work_dir(spark)


def test_model_folder_has_the_rights_of_the_shared_folder(spark, tmp_path, monkeypatch):
    """Sessions of other users write in it too, whoever made it first."""
    folder, shared = given_tables(spark, tmp_path / "given"), tmp_path / "shared"
    shared.mkdir()
    shared.chmod(0o1777)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(shared))
    assert catalog.run(spark, folder, "kpi_1a_monthly_trend").count()
    assert {p.name: stat.S_IMODE(p.stat().st_mode) for p in shared.iterdir()} == {"ledgerlens-model": 0o1777}
