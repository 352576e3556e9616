"""Best-fit packing into bins of several permitted lengths.

Documents are cut into segments of at most the largest length; segments are dealt
to shards and packed there, longest first, each into the open bin it fills best. If
none has room, every length that holds the segment is tried on the sizes still to
come, largest first, and the one opens that then costs least for each token placed.
Last, every bin shrinks to the smallest length that holds it.

Lengths that look cheap one by one need not be so together, so a shard is also
packed with each length alone (longer ones for what does not fit), and the
cheapest of these plans stays: a shard never costs more than with its best single length.

A bin of length c costs ``c + c * c / QUADRATIC + PER_BIN``: long sequences pay for
attention, every sequence for its start. A shard sees only its own segments, so
its memory follows the partition count; each shard leaves at most a few bins part full.
Shards are drawn by a hash of the row, repeats numbered, so one id that holds many
rows, or the same row again and again, is spread over all of them.

Cases: null and empty texts are one token, the end; repeated rows are packed each
for itself; equal lengths go in the order of id and start, nulls first; a very long text becomes
several segments; other columns are not read; an empty table has no bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textkit as tk
from skyloom.llm.work import exchange, partitions

LENGTHS = (512, 1024, 2048, 4096, 8192)
QUADRATIC, PER_BIN = 32768.0, 16.0


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / QUADRATIC + PER_BIN


class _Remaining:
    """The multiset of sizes still to come."""

    def __init__(self, sizes: list[int], largest: int):
        self.count = [0] * (largest + 1)
        for size in sizes:
            self.count[size] += 1
        self.bits = sum(1 << size for size, n in enumerate(self.count) if n)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.bits ^= 1 << size

    def fill(self, room: int) -> int:
        """Tokens that go into ``room``, largest sizes first."""
        used, limit = 0, room
        while low := self.bits & ((2 << limit) - 1):
            size = low.bit_length() - 1
            n = min(self.count[size], (room - used) // size)
            used += n * size
            limit = min(room - used, size - 1)
        return used


def _shrunk(used: int, lengths: tuple[int, ...]) -> int:
    return next(c for c in lengths if c >= used)


def _opened(size: int, remaining: _Remaining, lengths: tuple[int, ...]) -> int:
    """The length that costs least for each token, if it is filled with what is still to come."""
    best = None
    for c in lengths:
        if c >= size:
            used = size + remaining.fill(c - size)
            price = cost(_shrunk(used, lengths)) / used
            if best is None or price < best[0]:
                best = price, c
    if best is None:
        raise ValueError(f"no length holds {size} tokens")
    return best[1]


def _best_fit(sizes: list[int], lengths: tuple[int, ...], single: int | None) -> list[list[int]]:
    """The items of each bin; with ``single`` bins open at that length, or the next that holds the item."""
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    open_ = 0  # bit r: a bin has r tokens of room
    bins: list[list[int]] = []
    remaining = _Remaining(sizes, max(sizes, default=0))
    for item, size in enumerate(sizes):
        remaining.take(size)
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r = _opened(size, remaining, lengths) if single is None else _shrunk(max(size, single), lengths)
            b = len(bins)
            bins.append([])
        bins[b].append(item)
        r -= size
        if r:
            open_ |= 1 << r
            room[r].append(b)
    return bins


def pack_lengths(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, list[int]]]:
    """(length, item indices) of each bin; sizes come longest first and none is over the largest length."""
    lengths = tuple(sorted(lengths))
    best = None
    for single in (None, *lengths):
        plan = [(_shrunk(sum(sizes[i] for i in held), lengths), held) for held in _best_fit(sizes, lengths, single)]
        total = sum(cost(c) for c, _ in plan)
        if best is None or total < best[0]:
            best = total, plan
    return best[1]


def _sizes(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = [w.counts + 1 for _, _, w in tk.batches_of_words(batch, "text")]
            n = np.concatenate([np.zeros(0, np.int64), *n])
            row = batch.column("row").to_numpy().view(np.uint64)
            order = np.argsort(row, kind="stable")
            first = tk.runs(row[order])
            nth = np.empty(len(row), np.uint64)
            nth[order] = (np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))).astype(np.uint64)
            bucket = (tk.mix(row ^ tk.mix(nth)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("id"), pa.array(n.astype(np.int64))], names=["bucket", "id", "n"])

    return run


def _pack(lengths: tuple[int, ...], shards: int):
    largest = max(lengths)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in it for x in zip(b.column("bucket").to_pylist(), b.column("id").to_pylist(), b.column("n").to_pylist(), strict=True)]
        if not rows:
            return
        shard = rows[0][0]
        segments = [(min(largest, n - a), id, a) for _, id, n in rows for a in range(0, n, largest)]
        segments.sort(key=lambda s: (-s[0], s[1] is not None, s[1], s[2]) if s[1] is not None else (-s[0], False, 0, s[2]))
        bins = pack_lengths([s[0] for s in segments], lengths)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        for i in range(0, len(bins), 5000):
            part = bins[i : i + 5000]
            held = [[segments[x] for x in members] for _, members in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(i + k) * shards + shard for k in range(len(part))], pa.int64()),
                    pa.array([c for c, _ in part], pa.int64()),
                    pa.array([sum(s[0] for s in h) for h in held], pa.int64()),
                    pa.array([[s[1] for s in h] for h in held], pa.list_(pa.int64())),
                    pa.array([[{"doc_id": s[1], "start": s[2], "n_tokens": s[0]} for s in h] for h in held], kind),
                ],
                names=["bin_id", "capacity", "used", "doc_ids", "segments"],
            )

    return run


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per bin: bin_id, capacity, used, doc_ids and segments (document, first token, tokens).

    Tokens are the words of a text and one end.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).withColumn("row", F.xxhash64("id", "text"))
    sizes = rows.mapInArrow(_sizes(n), "bucket int, id long, n long")
    out = "bin_id long, capacity long, used long, doc_ids array<long>, segments array<struct<doc_id:long,start:long,n_tokens:long>>"
    return exchange(sizes).mapInArrow(_pack(lengths, n), out)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
