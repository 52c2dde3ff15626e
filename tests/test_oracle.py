"""Every registered report against its reference-form DuckDB SQL.

* on the hand-made edge fixture (model tables written to Parquet), and
* on the driver test data at sf0.001 through the adapters, as the driver does.
"""

import os

import duckdb
import pytest

from ledgerlens.plans import catalog
from ledgerlens.plans.boundary import normalise
from ledgerlens.plans.oracle import model_sql, oracle_sql
from tools.compare import diff

NAMES = [r.name for r in catalog.REPORTS]
MODEL_NAMES = [r.name for r in catalog.REPORTS if r.bundle is not None]
SF_DIR = "/root/testdata/sf0.001"
TEST_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def fixture_duck(spark, fixture_tables, scratch):
    con = duckdb.connect()
    for name, df in fixture_tables.as_dict().items():
        path = os.path.join(scratch, "fixture", name)
        df.write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con


@pytest.fixture(scope="module")
def testdata_duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        p = os.path.join(SF_DIR, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", MODEL_NAMES)
def test_fixture_matches_reference_sql(name, fixture_tables, fixture_duck):
    r = catalog.BY_NAME[name]
    got = normalise(r.fn(fixture_tables, **r.params)).toPandas()
    want = fixture_duck.execute(model_sql(name)).df()
    assert diff(got, want) is None, diff(got, want)


@pytest.mark.parametrize("name", NAMES)
def test_testdata_matches_oracle(name, spark, testdata_duck):
    got = catalog.run(spark, SF_DIR, name).toPandas()
    want = testdata_duck.execute(oracle_sql()[name]).df()
    assert diff(got, want) is None, diff(got, want)
