"""Edges of a graph are computed once; neighbours in many small blocks are those of all pairs."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import kernels, relation


def test_edges_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    nodes = spark.range(40).selectExpr("id AS node", "id % 2 AS token")
    edges = spark.range(38).select(F.col("id").alias("src"), (counted.asNondeterministic()("id") + 2).alias("dst"))
    got = kernels.graph_components(nodes, edges.where("src <> 10"), str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, 2, 0.7), (1, 1, 1.0)]
    assert seen.value <= 38


def test_neighbours_in_several_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(relation, "TILE", 64)
    x = np.random.default_rng(0).integers(-3, 4, (500, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    near = relation.k_nearest(df, df, 3, drop_self=True)
    got = {(r.src, r.slot): (r.dst, r.score) for r in near.collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for i in range(500):
        order = np.lexsort((np.arange(500), -s[i]))[:3]
        assert [got[i, k + 1] for k in range(3)] == [(int(j), s[i, j]) for j in order]
