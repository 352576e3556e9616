import os

import pytest
from pyspark.sql import functions as F

from skyloom.operators import sequence
from skyloom.streaming import rollups

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no driver tables")


@pytest.fixture()
def source(spark, tmp_path):
    """The events in time order over a few files."""
    events = spark.read.parquet(f"{ROOT}/events.parquet").orderBy("ts", "event_id")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/events")
    return events, rollups.event_stream(spark, f"{tmp_path}/events", events.schema, files=10)


def test_windows_equal_the_batch(spark, source, tmp_path):
    events, stream = source
    got = rollups.run_once(rollups.windowed(stream), "windows", f"{tmp_path}/c", "complete")
    want = events.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.max("value").alias("m"), F.count("*").alias("n"))
    a = sorted((r.user_id, str(r.window.start), r.max_value, r.n) for r in got.collect())
    b = sorted((r.user_id, str(r.h), r.m, r.n) for r in want.collect())
    assert a == b


def test_sessions_and_sliding(spark, source, tmp_path):
    events, stream = source
    got = rollups.run_once(rollups.sessions(stream), "sessions", f"{tmp_path}/c1", "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    slid = rollups.run_once(rollups.sliding(stream, "2 hours", "1 hour"), "slid", f"{tmp_path}/c2", "complete")
    assert slid.agg(F.sum("n")).first()[0] == 2 * events.count()


def test_running_histogram_by_batches(spark, source, tmp_path):
    events, stream = source
    q = stream.writeStream.foreachBatch(rollups.merge_into(f"{tmp_path}/hist", "event_type")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_type: r.n for r in rollups.merged(spark, f"{tmp_path}/hist", "event_type").collect()}
    assert got == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_run_lengths_keep_the_open_run(spark, source, tmp_path):
    events, stream = source
    got = rollups.run_once(rollups.run_lengths(stream), "runs", f"{tmp_path}/c")
    whole = sequence.runs(events, "user_id", ["ts", "event_id"], "event_type")
    nodes = events.select("user_id").distinct().count()
    assert got.count() == whole.count() - nodes
