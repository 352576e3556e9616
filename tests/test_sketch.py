"""Mergeable quantiles against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import sketch as s

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
INF = float("inf")


def values():
    draw = random.Random(6)
    out = [("a", draw.lognormvariate(0, 3) * draw.choice([1, 1, -1])) for _ in range(400)] + [("b", 2.5)] * 200
    out += [("c", v) for v in (-INF, -1e308, -5e-324, 0.0, -0.0, 5e-324, 1.0, 1e308, INF, float("nan"), None)] + [("d", None), (None, 7.0)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("accuracy", [0.0001, 0.01, 0.3])
def test_bounds_hold(spark, accuracy):
    rows = spark.createDataFrame([(k, v, i % 7) for i, (k, v) in enumerate(values())], "k string, v double, bucket int")
    got = {(r.k, r.share): r for r in s.quantiles(s.sketch(rows, ["k"], F.col("v"), accuracy), ["k"], SHARES, accuracy).collect()}
    own = {}
    for k, v in values():
        if v is not None:
            own.setdefault(k, []).append(v)
    assert set(got) == {(k, q) for k in own for q in SHARES}
    for k, vs in own.items():
        vs.sort(key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
        for q in SHARES:
            true, r = vs[int(q * (len(vs) - 1))], got[k, q]
            assert r.n == len(vs)
            if math.isnan(true):
                assert math.isnan(r.estimate) and math.isnan(r.low)
                continue
            assert r.low <= true <= r.high
            assert r.estimate == true if math.isinf(true) or true == 0 else abs(r.estimate - true) <= (accuracy + 1e-9) * abs(true) + 5e-324


def test_blocks_add_up_to_the_whole(spark, tmp_path):
    """Any cut, a block written twice, and a sketch of all rows at once are the same."""
    rows = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(values())], "k string, v double, i int")
    kept = s.Percentiles(spark, str(tmp_path / "p"), ["k"], "v")
    for name, part in (("x", "i % 3 = 0"), ("y", "i % 3 = 1"), ("x", "i % 3 = 0"), ("z", "i % 3 = 2"), ("none", "i < 0")):
        kept.add(rows.where(part), name)
    key = lambda r: str(tuple(r))
    whole = s.quantiles(s.sketch(rows, ["k"], F.col("v")), ["k"], SHARES)
    assert sorted(map(key, kept.result(SHARES).collect())) == sorted(map(key, whole.collect()))
    with pytest.raises(ValueError):
        kept.add(rows, "../x")
    with pytest.raises(ValueError):
        s.sketch(rows, ["k"], F.col("v"), 1e-6)


def test_no_rows(spark, tmp_path):
    kept = s.Percentiles(spark, str(tmp_path / "p"), ["k"], "v")
    kept.add(spark.createDataFrame([], "k string, v double"), "only")
    assert kept.result(SHARES).count() == 0


def test_a_stream_keeps_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(k, v) for k, v in values()], "k string, v double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    kept = s.Percentiles(spark, str(tmp_path / "p"), ["k"], "v")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(kept.from_stream()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = s.quantiles(s.sketch(rows, ["k"], F.col("v")), ["k"], SHARES)
    assert len(list((tmp_path / "p").glob("block=*"))) > 1
    assert sorted(str(tuple(r)) for r in kept.result(SHARES).collect()) == sorted(str(tuple(r)) for r in want.collect())
