"""Waiting rows lie in the state in spans: few entries, the same order, and the same microseconds in any time zone."""

import datetime
import random
from collections import Counter

from pyspark.sql import Row

from skyloom.streaming import ordered, rollups

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


class Entries(list):
    """A list state that counts what it is given."""

    given = 0

    def appendList(self, more):
        self.given += len(more)
        self.extend(more)

    def put(self, entries):
        self[:] = entries

    def get(self):
        return iter(self)


class Value:
    kept = None

    def get(self):
        return self.kept

    def exists(self):
        return self.kept is not None

    def update(self, value):
        self.kept = value


class Handle:
    def __init__(self):
        self.waiting, self.open, self.timers = Entries(), Value(), []

    def getListState(self, name, schema):
        return self.waiting

    def getValueState(self, name, schema):
        return self.open

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_rows_wait_in_few_entries_and_are_folded_in_order():
    n, seen = 5000, []
    rows = [(START + datetime.timedelta(milliseconds=i // 3), i % 7, f"{i}") for i in range(n)]
    random.Random(1).shuffle(rows)
    made = Row("user_id", "ts", "_tie", "_what")
    handle = Handle()
    step = ordered.InOrder("", "", lambda carry, ready: (seen.extend(ready), ((0, 0), []))[1], ("user_id", "x", "y"))
    step.init(handle)
    assert list(step.handleInputRows((1,), iter([made(1, *row) for row in rows]), None)) == []
    assert handle.waiting.given <= n // 50
    first = int(START.timestamp() * 1000)
    assert handle.timers == [first + 1]
    micros = lambda ts: (ts - START) // datetime.timedelta(microseconds=1) + first * 1000
    want = sorted(((micros(ts), tie, what) for ts, tie, what in rows), key=lambda r: r[:2])
    for ms in (first + 700, first + n):
        assert list(step.handleExpiredTimer((1,), Clock(ms), None)) == []
        assert seen == [r for r in want if r[0] < ms * 1000]
    assert sum(len(at) for at, _, _ in handle.waiting) == 0 or not handle.waiting


def test_the_hour_that_comes_twice(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    at = datetime.datetime(2024, 11, 3, 5, 30, 0, 7, tzinfo=datetime.UTC)
    times = [at, at + datetime.timedelta(hours=1), at + datetime.timedelta(hours=2, microseconds=5), at + datetime.timedelta(hours=9)]
    frame = spark.createDataFrame([(i, ts, None if i % 2 else 3, "a", None) for i in range(2) for ts in times], SCHEMA)
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = rollups.run_once(ordered.steps(rollups.event_stream(spark, f"{tmp_path}/in", frame.schema)), "steps", f"{tmp_path}/c").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    micros = [int(ts.timestamp()) * 1_000_000 + ts.microsecond for ts in times[:3]]
    gaps = [None, 3_600_000_000, 3_600_000_005]
    assert Counter((r.user_id, r.at, r.gap, r.change) for r in got) == Counter((user, a, gap, None) for user in (3, None) for a, gap in zip(micros, gaps, strict=True))


def test_null_tokens_and_a_hot_node_over_many_spans(spark, tmp_path):
    """One node has 300 rows, in two files; null tokens are tokens; what lies within the lateness waits."""
    rows = [(i, START + datetime.timedelta(minutes=i), 1, [None, "a", "a", "b"][i % 4], None) for i in range(300)]
    for part in (rows[100:200] + rows[:100], rows[:199:-1]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rollups.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
        got = rollups.run_once(ordered.run_lengths(stream), "runs", f"{tmp_path}/c")
    # 299 - 120 = 179: rows up to minute 178 are behind, and the run of minutes 177 and 178 is still open.
    assert Counter(map(tuple, got.collect())) == Counter({(1, None, 1): 45, (1, "a", 2): 44, (1, "b", 1): 44})
