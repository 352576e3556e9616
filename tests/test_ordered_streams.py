"""Streams against the batch under shuffled arrival: ordered state, interval joins, scores of snapshots, tables in place of memory."""

import datetime
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyloom.streaming import ordered, rollups

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
LATE = 7200


def events(n, seed, users=4):
    """Rows in order of time; a third of them of user 0, some tied, some with null tokens and values."""
    draw, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += draw.choice([0, 1, 60, 600])
        user = 0 if draw.random() < 0.34 else draw.randrange(1, users)
        rows.append((i, START + datetime.timedelta(seconds=at), user, draw.choice(["a", "b", None]), draw.choice([1.0, 2.5, None])))
    return rows


def arriving(spark, folder, rows, seed, files=5):
    """The rows in files, each row delayed by up to 90 minutes: order within and between files is lost."""
    draw = random.Random(seed)
    shuffled = sorted(rows, key=lambda r: (r[1] - START).total_seconds() + draw.random() * 5400)
    size = -(-len(shuffled) // files)
    for i in range(0, len(shuffled), size):
        part = shuffled[i : i + size]
        draw.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return rollups.event_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)


def behind(rows):
    last = max(r[1] for r in rows) - datetime.timedelta(seconds=LATE)
    return [r for r in rows if r[1] < last]


def by_user(rows):
    users = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        users.setdefault(r[2], []).append(r)
    return users


def finished_runs(rows):
    out = Counter()
    for user, own in by_user(rows).items():
        token, n = own[0][3], 0
        for r in own:
            if r[3] != token:
                out[(user, token, n)] += 1
                token, n = r[3], 0
            n += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_in_order_under_shuffled_arrival(spark, tmp_path, seed):
    rows = events(300, seed)
    got = rollups.run_once(ordered.run_lengths(arriving(spark, f"{tmp_path}/in", rows, seed)), "runs", f"{tmp_path}/c")
    assert Counter(map(tuple, got.collect())) == finished_runs(behind(rows))


def test_steps_under_shuffled_arrival(spark, tmp_path):
    rows = events(200, 3)
    got = rollups.run_once(ordered.steps(arriving(spark, f"{tmp_path}/in", rows, 3)), "steps", f"{tmp_path}/c")
    want = set()
    for user, own in by_user(behind(rows)).items():
        for before, r in zip([None, *own], own):
            gap = before and int((r[1] - before[1]).total_seconds() * 1e6)
            change = None if before is None or before[4] is None or r[4] is None else r[4] - before[4]
            want.add((user, r[0], gap, change))
    assert {(r.user_id, r.tie, r.gap, r.change) for r in got.collect()} == want and got.count() == len(want)


def test_a_second_start_goes_on_with_the_state(spark, tmp_path):
    rows = events(240, 4)
    head, tail = rows[:120], rows[120:]
    stream = arriving(spark, f"{tmp_path}/in", head, 4, files=2)
    rollups.run_once(ordered.run_lengths(stream), "runs", f"{tmp_path}/c")
    stream = arriving(spark, f"{tmp_path}/in", tail, 5, files=2)
    got = rollups.run_once(ordered.run_lengths(stream), "runs", f"{tmp_path}/c")
    assert Counter(map(tuple, got.collect())) == finished_runs(behind(rows))
    again = rollups.run_once(ordered.run_lengths(stream), "runs", f"{tmp_path}/c")
    assert again.count() == got.count()


def test_rows_without_a_time_are_left_out_and_no_rows_give_none(spark, tmp_path):
    rows = [*events(60, 6), (900, None, 0, "a", 1.0), (901, None, None, None, None)]
    known = [r for r in rows if r[1] is not None]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.createDataFrame([], SCHEMA).schema
    got = rollups.run_once(ordered.run_lengths(rollups.event_stream(spark, f"{tmp_path}/in", schema)), "runs", f"{tmp_path}/c")
    assert Counter(map(tuple, got.collect())) == finished_runs(behind(known))
    (tmp_path / "none").mkdir()
    none = rollups.event_stream(spark, f"{tmp_path}/none", schema)
    assert rollups.run_once(ordered.run_lengths(none), "none", f"{tmp_path}/c2").collect() == []
    assert rollups.run_once(rollups.running_histogram(none, "event_type"), "none", f"{tmp_path}/c3", "complete").collect() == []


def test_interval_join_under_shuffled_arrival(spark, tmp_path):
    rows = [*events(150, 7), (700, None, 0, "a", 1.0), (701, START, None, "b", 1.0)]
    stream = arriving(spark, f"{tmp_path}/in", [r for r in rows if r[1]], 7)
    a, b = (stream.where(F.col("event_type") == t) for t in "ab")
    got = rollups.run_once(rollups.interval_join(a, b, "user_id", 600), "pairs", f"{tmp_path}/c")
    want = Counter((x[0], y[0]) for x in rows for y in rows if x[1] and y[1] and x[2] is not None and x[2] == y[2] and x[3] == "a" and y[3] == "b" and 0 <= (y[1] - x[1]).total_seconds() <= 600)
    assert want and Counter((r.event_id, r.event_id_right) for r in got.collect()) == want


def test_update_and_complete_tables(spark, tmp_path):
    rows = events(100, 8)
    stream = arriving(spark, f"{tmp_path}/in", rows, 8)
    want = Counter(r[3] for r in rows)
    whole = rollups.run_once(rollups.running_histogram(stream, "event_type"), "h", f"{tmp_path}/c1", "complete")
    latest = rollups.run_once(rollups.running_histogram(stream, "event_type"), "h", f"{tmp_path}/c2", "update", ("event_type",))
    assert {r.event_type: r.n for r in whole.collect()} == want == {r.event_type: r.n for r in latest.collect()}


def bits(own, base):
    kinds = set(own) | set(base)
    p = {k: (own.get(k, 0) + 0.5) / (sum(own.values()) + len(kinds) / 2) for k in kinds}
    q = {k: (base.get(k, 0) + 0.5) / (sum(base.values()) + len(kinds) / 2) for k in kinds}
    return sum(p[k] * math.log2(p[k] / q[k]) for k in kinds)


def test_snapshot_scores_by_files_as_they_come(spark, tmp_path):
    """A new file is scored when it comes; those before keep their scores, whatever batch they came in."""
    schema, table = spark.createDataFrame([], SCHEMA).schema, f"{tmp_path}/scores"
    base = {"a": 7, "z": 3}
    baseline = spark.createDataFrame(list(base.items()), "event_type string, n long")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rollups.event_stream(spark, f"{tmp_path}/in", schema, name="file")
        write = rollups.merge_into(table, "file", "event_type")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        counts = rollups.merged(spark, table, "file", "event_type")
        return {r.file: (r.n, r.bits) for r in rollups.snapshot_scores(counts, "file", "event_type", baseline).collect()}

    first, more = events(40, 9), events(70, 10)
    one = run(first)
    assert [n for n, _ in one.values()] == [40]
    assert math.isclose(next(iter(one.values()))[1], bits(Counter(r[3] for r in first), base))
    two = run(more)
    assert len(two) == 2 and sorted(n for n, _ in two.values()) == [40, 70]
    known = set(base) | {r[3] for r in first} | {r[3] for r in more}
    for name, rows in ((next(iter(one)), first), (next(k for k in two if k not in one), more)):
        want = bits({**dict.fromkeys(known, 0), **Counter(r[3] for r in rows)}, base)
        assert math.isclose(two[name][1], want)
