"""Registered queries with SQL agree with DuckDB on small driver tables and on planted copies."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from skyloom.llm import queries
from tests.llm.common import docs, prose

ROOT = "/root/testdata/sf0.001"


def compare(spark, root, name):
    con = duckdb.connect()
    for p in glob.glob(f"{root}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got, want = queries.QUERIES[name](spark, root).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_driver_tables(spark, name):
    compare(spark, ROOT, name)


def test_planted(spark, tmp_path):
    shared = prose(1, 50)
    docs(spark, [prose(i, 90) for i in range(20)] + [f"{prose(40 + i, 30)} {shared}" for i in range(4)] + [prose(3, 90), None, ""]).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), "op3_substring_dedup")
    rows = [(i, [1.0, 0.01 * (i % 9), 0.0], i % 2) for i in range(30)] + [(40, [0.0, 0.0, 0.0], 1), (41, [1.0, 0.0, 0.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(spark, str(tmp_path), "op10_embedding_dedup")
