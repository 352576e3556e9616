"""The spanning tree of density clusters ships no pairs of blocks, and is the same as in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import density


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def rows_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<double>").repartition(3)


def test_shuffles_do_not_grow_with_the_blocks(spark):
    n, size = 1600, 32
    rows = rows_of(spark, np.random.default_rng(1).normal(size=(n, size))).cache()
    rows.count()
    before = shuffled(spark)
    assert density.density_clusters(rows, "vec", block=50).count() == n
    # Every vector once to each of 32 blocks, on either side, would be 64 times the vectors.
    assert shuffled(spark) - before < 16 * n * size * 8


def cases():
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(80, 5))
    yield "plain", plain
    yield "copies", np.repeat(plain[:20], 4, axis=0)[rng.permutation(80)]
    yield "many copies of few", np.concatenate([np.repeat(plain[:3], 20, axis=0), plain[3:13]])[rng.permutation(70)]
    yield "all the same", np.repeat(plain[:1], 70, axis=0)
    # A point in reach of many copies, whose core distance is longer than none.
    yield "copies beside a lattice", np.concatenate([rng.integers(0, 3, (50, 2)), np.repeat([[9, 9], [1, 1]], 2, axis=0), [[9, 10], [8, 9]] * 3]).astype(float)
    yield "lattice", rng.integers(0, 6, (80, 2)).astype(float)
    yield "all as far", np.eye(70)
    yield "far groups", np.concatenate([plain[:20] + [1000.0 * g, 0, 0, 0, 300.0 * (g % 2)] for g in range(4)])[rng.permutation(80)]
    yield "near copies", np.concatenate([plain[:4] + 1e-3 * rng.normal(size=(4, 5)) for _ in range(20)])
    yield "huge and tiny", plain * np.where(np.arange(80)[:, None] % 4 == 0, 1e160, np.where(np.arange(80)[:, None] % 4 == 1, 1e-170, 1.0))
    yield "signs of zero", np.where(rng.integers(0, 2, (60, 2)) == 0, -0.0, 0.0) + rng.integers(0, 3, (60, 2)) * [1.0, 0.0]


@pytest.mark.parametrize("name, x", list(cases()))
@pytest.mark.filterwarnings("ignore:overflow", "ignore:invalid")
def test_the_tree_of_blocks_is_that_of_one_place(spark, monkeypatch, name, x):
    monkeypatch.setattr(density, "MORE", 2)
    k, n = 3, len(x)
    core = density.least_distances(x.T.copy(), x.T.copy(), k)[:, -1]
    want = sorted(zip(*(v.tolist() for v in density.spanning_tree(x.T.copy(), core, np.arange(n)))))
    tables = density._Tables(spark)
    good = rows_of(spark, x)
    points = tables.keep(good.groupBy("vec").agg(F.min("node").alias("node"), F.count("*").alias("times")))
    tree, cores = density._tree(points, points.count(), k, 25, tables)
    got = sorted(map(tuple, density._with_copies(tree, cores, points, good).collect()))
    assert got == want and len(want) == n - 1
