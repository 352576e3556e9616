"""Run lengths of a stream: only what the runs need goes to Python, and odd rows keep their place."""

import datetime
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from skyloom.streaming import rollups

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def at(minute):
    return None if minute is None else datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minute)


def written(spark, folder, rows):
    frame = spark.createDataFrame([(i, at(m), user, kind, 1.0, "p") for i, (m, user, kind) in enumerate(rows)], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(folder)
    return rollups.event_stream(spark, folder, frame.schema)


def test_only_node_time_and_token_are_shuffled(spark, tmp_path):
    stream = written(spark, f"{tmp_path}/in", [(0, 1, "a")])
    plan = rollups.run_lengths(stream)._jdf.queryExecution().analyzed()
    while "FlatMapGroupsInPandasWithState" not in plan.nodeName():
        plan = plan.children().head()
    assert plan.children().head().output().size() == 3


@pytest.mark.parametrize("n", [1, 16, 17, 700])
def test_order_is_that_of_a_frame_of_timestamps(n):
    draw = np.random.default_rng(n)
    us = draw.integers(-5, 20, n) * 60_000_000 + 1_704_067_200_000_000
    none = draw.random(n) < 0.2
    frame = pd.DataFrame({"ts": pd.Series(us.astype("M8[us]").astype("M8[ns]")).mask(none), "row": range(n)})
    assert rollups._in_time(np.where(none, rollups._NO_TIME, us)).tolist() == frame.sort_values("ts")["row"].tolist()


def test_odd_rows_and_a_second_batch(spark, tmp_path):
    rows = [
        (3, 1, "b"), (0, 1, "a"), (1, 1, "a"), (1, 1, "a"), (4, 1, "b"),
        (0, 2, None), (1, 2, "a"), (2, 2, None), (3, 2, None), (4, 2, "c"), (5, 2, "d"),
        (0, None, "a"), (1, None, "b"), (None, None, "b"), (None, 3, "x"), (0, 3, "y"), (0, 4, "z"), (None, 5, None),
    ]
    got = rollups.run_once(rollups.run_lengths(written(spark, f"{tmp_path}/in", rows)), "runs", f"{tmp_path}/c")
    # Runs of null tokens end the others and are no rows of their own; rows without a time come last.
    first = [(1, "a", 3), (2, "a", 1), (2, "c", 1), (None, "a", 1), (3, "y", 1)]
    assert Counter(map(tuple, got.collect())) == Counter(first)
    stream = written(spark, f"{tmp_path}/in", [(9, 1, "b"), (10, 1, "a"), (9, None, "c"), (9, 4, "z"), (9, 5, "q")])
    got = rollups.run_once(rollups.run_lengths(stream), "runs", f"{tmp_path}/c")
    assert Counter(map(tuple, got.collect())) == Counter([*first, (1, "b", 3), (None, "b", 2)])
