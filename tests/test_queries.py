"""Every registered query with SQL agrees with DuckDB on small driver tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from skyloom.plans import engine, probes, skies  # noqa: F401

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(probes.QUERIES))
def test_query(spark, db, name):
    got = probes.QUERIES[name](spark, ROOT).toPandas()
    if name not in probes.ORACLES:
        assert len(got) > 0
        return
    want = db.sql(probes.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_entry(spark):
    import __spark_entry__

    assert set(probes.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(ROOT):
        assert __spark_entry__.entry(spark).count() > 0
