"""Sequences in blocks equal the windows over whole nodes, for any cut."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.operators import along, sequence

ORDER = ["t", "tie"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for node, n in ((1, 300), (2, 41), (3, 1), (None, 60)):
        token, t = "a", 0
        for i in range(n):
            token = rng.choice(["a", "b", "c", None]) if rng.random() < 0.3 else token
            t += rng.choice([0, 1, 1, 9])
            out.append((node, t, i, token, None if rng.random() < 0.1 else round(rng.uniform(-5, 5), 2)))
    # All ticks of one moment lie in one block; some blocks are empty, some hold a single row.
    return spark.createDataFrame(out, "node int, t int, tie int, token string, value double").cache()


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


CUTS = [1, 3, 17, 100, 10**6]


@pytest.mark.parametrize("size", CUTS)
def test_runs_and_transitions(rows, size):
    cut = rows.withColumn("block", F.floor(F.col("t") / size))
    want = sequence.runs(rows, "node", ORDER, "token")
    assert pairs(along.runs(cut, "node", "block", ORDER, "token"), "node", "token", "run_len") == pairs(want, "node", "token", "run_len")
    want = sequence.transitions(rows, "node", ORDER, "token")
    assert pairs(along.transitions(cut, "node", "block", ORDER, "token"), "prev", "token", "n", "probability") == pairs(want, "prev", "token", "n", "probability")


def test_summaries_of_blocks_join_whenever_they_were_made(rows):
    cut = rows.withColumn("block", F.floor(F.col("t") / 20))
    early, late = (along.run_summaries(cut.where(w), "node", "block", ORDER, "token") for w in ("block < 7", "block >= 7"))
    got = along.joined_runs(late.union(early), "node", "block", "token")
    assert pairs(got, "node", "token", "run_len") == pairs(sequence.runs(rows, "node", ORDER, "token"), "node", "token", "run_len")
    ends = late.where("place <> 1").groupBy("node", "block").count()
    assert ends.agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("size", CUTS)
def test_lags_sums_and_positions(rows, size):
    cut = rows.withColumn("block", F.floor(F.col("t") / size))
    whole, part = Window.partitionBy("node").orderBy(*ORDER), Window.partitionBy("node", "block").orderBy(*ORDER)
    ops = lambda w: {"step": sequence.delta(F.col("value"), w), "bend": sequence.second_difference(F.col("value"), w), "next": F.lead("token").over(w)}
    got = along.with_halo(cut, "node", "block", ORDER).withColumns(ops(part)).where("_own")
    assert pairs(got, "node", "tie", "step", "bend", "next") == pairs(rows.withColumns(ops(whole)), "node", "tie", "step", "bend", "next")
    total = F.round(F.sum("value").over(whole.rowsBetween(Window.unboundedPreceding, 0)), 6)
    got = along.running_sum(cut, "node", "block", ORDER, "value", "total").withColumn("total", F.round("total", 6))
    assert pairs(got, "node", "tie", "total") == pairs(rows.withColumn("total", total), "node", "tie", "total")
    got = along.position(cut, "node", "block", ORDER, "i")
    assert pairs(got, "node", "tie", "i") == pairs(rows.withColumn("i", F.row_number().over(whole) - 1), "node", "tie", "i")


def test_empty(rows):
    cut = rows.where("t < 0").withColumn("block", F.lit(1))
    assert along.runs(cut, "node", "block", ORDER, "token").count() == along.with_halo(cut, "node", "block", ORDER).count() == 0


def test_no_task_holds_a_node(rows):
    plan = along.runs(rows.withColumn("block", F.floor(F.col("t") / 20)), "node", "block", ORDER, "token")._jdf.queryExecution().executedPlan().toString()
    by_rows = [x for x in plan.splitlines() if "Window [" in x and "t#" in x and "tie#" in x]
    assert by_rows and all("block#" in x for x in by_rows)
