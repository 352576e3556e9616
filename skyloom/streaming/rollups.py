"""Streams: windowed roll-ups, running histograms, sessions, interval joins, scores of snapshots, and run lengths kept per node."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files: int = 1, name: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ts as a timestamp, which watermarks need. With ``name``, a column of that name says which file."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    if name:
        raw = raw.withColumn(name, F.col("_metadata.file_name"))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Maximum, mean and count per window and key; rows later than the watermark are dropped, windows close behind it."""
    kept = events.withWatermark("ts", late).groupBy(F.window("ts", length), *by)
    return kept.agg(F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.count("*").alias("n"))


def sliding(events: DataFrame, length: str, step: str, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def running_histogram(events: DataFrame, token: str) -> DataFrame:
    """Counts so far; write in complete or update mode."""
    return events.groupBy(token).agg(F.count("*").alias("n"))


def interval_join(left: DataFrame, right: DataFrame, key: str, within: int, late: str = "2 hours") -> DataFrame:
    """Pairs of a left row and a right row of the same key that comes 0 to ``within`` seconds after it, both ends included.

    Right columns get the suffix ``_right``. Both sides have watermarks, so state older than ``late`` and the
    interval goes. The key is joined with the slot of ``within`` seconds: a key with a third of all rows
    spreads over its slots, and a left row waits in its own slot and the next, where alone its partners can lie.
    Null keys and null times have no partner.
    """

    def slot(ts: str):
        return F.floor(F.unix_micros(ts) / (within * 1_000_000))

    first = left.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", late)
    first = first.withColumn("_slot", F.explode(F.array(slot("ts"), slot("ts") + 1)))
    second = right.where(F.col("ts").isNotNull() & F.col(key).isNotNull())
    second = second.select([F.col(c).alias(f"{c}_right") for c in right.columns]).withWatermark("ts_right", late)
    second = second.withColumn("_slot_right", slot("ts_right"))
    near = F.expr(f"ts_right >= ts AND ts_right <= ts + INTERVAL {within} SECONDS")
    both = first.join(second, (F.col(key) == F.col(f"{key}_right")) & (F.col("_slot") == F.col("_slot_right")) & near)
    return both.drop("_slot", "_slot_right")


def merge_into(table: str, *tokens: str):
    """A foreachBatch function that adds each batch's counts to a Parquet table, once per batch id.

    Each batch has a folder of its own, which a repeated batch overwrites; readers add the folders up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*tokens).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return write


def merged(spark: SparkSession, table: str, *tokens: str) -> DataFrame:
    return spark.read.parquet(table).groupBy(*tokens).agg(F.sum("n").alias("n"))


def snapshot_scores(counts: DataFrame, snapshot: str, token: str, baseline: DataFrame | None = None) -> DataFrame:
    """Bits by which each snapshot's tokens depart from the baseline's: sum of p * log2(p / q).

    ``counts`` and ``baseline`` have token and n; without a baseline, all snapshots together are it. Both are
    smoothed by a half count a token that either knows, so that the score is finite. Counts of a snapshot that
    came in several batches add up before they are scored. A null snapshot or token is one of its own.
    """
    by = counts.groupBy(snapshot, token).agg(F.sum("n").alias("n"))
    base = (baseline if baseline is not None else counts).select(token, F.col("n").cast("double").alias("_q"))
    known = base.union(by.select(token, F.lit(0.0))).groupBy(token).agg(F.sum("_q").alias("_q"))
    sums = known.agg(F.sum("_q").alias("_all"), F.count("*").alias("_kinds"))
    known = known.crossJoin(sums).select(F.col(token).alias("_token"), ((F.col("_q") + 0.5) / (F.col("_all") + F.col("_kinds") / 2)).alias("_q"), "_kinds")
    totals = by.groupBy(snapshot).agg(F.sum("n").alias("_n"), F.count("*").alias("_seen"))
    # Absent tokens all have p = 0.5 / (n + kinds / 2); their part is a sum over the baseline less the present ones.
    logs = known.agg(F.sum(F.log2("_q")).alias("_logs"), F.first("_kinds").alias("_k"))
    present = by.join(known, by[token].eqNullSafe(F.col("_token"))).groupBy(snapshot).agg(
        F.sum((F.col("n") + 0.5) * F.log2(F.col("n") + 0.5) - F.col("n") * F.log2("_q")).alias("_own"), F.count("*").alias("_here")
    )
    rows = totals.withColumnRenamed(snapshot, "_s").join(present, F.col("_s").eqNullSafe(present[snapshot])).crossJoin(logs)
    size = F.col("_n") + F.col("_k") / 2
    # sum p log2 p = (own logs + absent * 0.5 * log2 0.5) / size - log2 size, and sum p log2 q likewise.
    bits = (F.col("_own") - (F.col("_k") - F.col("_here")) / 2 - F.col("_logs") / 2) / size - F.log2(size)
    return rows.select(snapshot, F.col("_n").alias("n"), F.col("_seen").alias("n_tokens"), bits.alias("bits"))


#: A row's time where it has none; no timestamp is as early.
_NO_TIME = -(2**63)


def _in_time(at):
    """Places of the rows in the order of a pandas sort by timestamps, ties included: rows without a time come last."""
    import numpy as np

    known = at != _NO_TIME
    return np.concatenate([np.flatnonzero(known)[at[known].view("M8[us]").argsort()], np.flatnonzero(~known)])


def run_lengths(events: DataFrame, node: str = "user_id", token: str = "event_type") -> DataFrame:
    """(node, token, run_len) of every finished run, the open one kept as state between batches.

    Events of a node must arrive in time order, as they do on a synthetic clock.
    """

    def step(key: tuple, pdfs: Iterator, state) -> Iterator:
        import pandas as pd

        current, n = state.get if state.exists else (None, 0)
        parts = list(pdfs)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        tokens, lengths = [], []
        for t in rows[token].take(_in_time(rows["_at"].to_numpy())):
            if t == current:
                n += 1
            else:
                if current is not None:
                    tokens.append(current)
                    lengths.append(n)
                current, n = t, 1
        state.update((current, n))
        if tokens:
            yield pd.DataFrame({node: [key[0]] * len(tokens), token: tokens, "run_len": lengths})

    kind = dict(events.dtypes)
    # Of a row, Python needs no more than these; a long spares it the time zone of each node's times.
    rows = events.select(node, F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME)).alias("_at"), token)
    return rows.groupBy(node).applyInPandasWithState(step, f"{node} {kind[node]}, {token} {kind[token]}, run_len long", f"{token} {kind[token]}, n long", "append", "NoTimeout")


#: State in RocksDB, which lies beside the heap and which timers need; a join's four kinds of state share one store a partition, not four.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def _state_on_disk(spark: SparkSession):
    """The settings of ``STATE`` for the queries that start inside."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Everything that is there now, as a table in the folder ``<checkpoint>-<name>``; nothing passes the driver.

    Each batch has a folder of its own, which a repeated batch overwrites. The table is all batches in append mode,
    the last one in complete mode, and the last row of each of ``keys`` in update mode. A stream without rows gives
    an empty table. Calling again goes on behind what was read.
    """
    spark, out = stream.sparkSession, f"{checkpoint}-{name}"
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/_batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    with _state_on_disk(spark):
        query = stream.writeStream.queryName(name).foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{stream.schema.toDDL()}, _batch LONG" if stream.columns else "_batch LONG").parquet(out)
    if mode == "complete":
        last = spark.read.schema("_batch LONG").parquet(out).agg(F.max("_batch").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_last")
    elif mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")
    return rows.drop("_batch")
