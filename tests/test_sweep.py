"""Moments against numpy, and a sweep that is killed and run again."""

import numpy as np
import pytest

from skyloom.operators import statistics, sweep

D = 50
FEATURES = [f"f{i}" for i in range(D)]


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, D))
    token = rng.integers(0, 3, 400)
    token[:200] = 1  # a hot token
    weight = rng.uniform(0.1, 2, 400)
    rows = [(int(t), i // 60, float(w), *map(float, v)) for i, (t, w, v) in enumerate(zip(token, weight, x))]
    schema = "token int, batch int, coverage double, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, schema).repartition(5).cache(), x, token, weight


def close(row, x, w):
    upper = np.triu_indices(D)
    assert row["n"] == len(x) and row["w"] == pytest.approx(w.sum())
    assert np.allclose(row["s"], w @ x) and np.allclose(row["p"], ((x * w[:, None]).T @ x)[upper])


@pytest.mark.parametrize("weight", [None, "coverage"])
def test_fifty_features_against_numpy(made, weight):
    rows, x, token, w = made
    got = {r["token"]: r for r in sweep.moments(rows, ["token"], FEATURES, weight).collect()}
    assert set(got) == {0, 1, 2}
    for t, row in got.items():
        close(row, x[token == t], w[token == t] if weight else np.ones((token == t).sum()))


def test_least_squares_agree_with_the_sql_sums(made):
    rows, *_ = made
    few = FEATURES[:4]
    old = statistics.ridge(statistics.moments(rows, few[:3], few[3]).first(), 3)
    assert np.allclose(sweep.ridge(sweep.moments(rows.selectExpr("*", "1 AS one"), ["one"], few).first(), 3), old)


def test_rows_that_count_in_nothing_and_odd_keys(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), (None, 1.0, 3.0), (None, 2.0, 1.0), ("a", None, 1.0), ("b", float("nan"), 1.0), ("a", 1.0, float("inf"))], "k string, x double, y double")
    got = {r["k"]: (r["n"], r["s"], r["p"]) for r in sweep.moments(rows, ["k"], ["x", "y"]).collect()}
    assert got == {"a": (1, [1.0, 2.0], [1.0, 2.0, 4.0]), None: (2, [3.0, 4.0], [5.0, 5.0, 10.0])}
    assert sweep.moments(rows.where("false"), ["k"], ["x", "y"]).count() == 0


class Killed(Exception):
    pass


def test_a_killed_sweep_goes_on_to_the_same_result(spark, made, tmp_path):
    rows, x, token, w = made
    few = FEATURES[:5]

    def kill(b):
        if b == 3:
            raise Killed

    whole = sweep.Sweep(spark, f"file://{tmp_path}/whole", ["token"], few, "coverage")
    assert whole.result().count() == 0
    assert whole.run(rows, "batch") == list(range(7))
    part = sweep.Sweep(spark, f"file://{tmp_path}/part", ["token"], few, "coverage")
    with pytest.raises(Killed):
        part.run(rows, "batch", before_entry=kill)
    # Batch 3 has its moments but no entry: it does not count yet.
    seen = sum(r["n"] for r in part.result().collect())
    assert seen == 180
    assert part.run(rows, "batch") == [3, 4, 5, 6] and part.run(rows, "batch") == []
    one, two = ({r["token"]: r for r in s.result().collect()} for s in (whole, part))
    assert {t: r["n"] for t, r in one.items()} == {t: int((token == t).sum()) for t in range(3)}
    for t in one:
        assert two[t]["n"] == one[t]["n"] and np.allclose(two[t]["p"], one[t]["p"], rtol=1e-12) and np.allclose(two[t]["s"], one[t]["s"], rtol=1e-12)
