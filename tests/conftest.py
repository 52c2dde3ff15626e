import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, app="ledgerlens-tests", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="ledgerlens-wh-")})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_tables(spark):
    from tests.fixture import build_tables
    return build_tables(spark)


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="ledgerlens-test-")
