"""Substring dedup: drop every word that a repeated fixed-length word window covers.

Every window of ``window`` consecutive words gets two independent Rabin-Karp hashes:
one names its bucket, the other is counted there; positions of repeated ones go back
to their documents, where they merge into maximal removal intervals. Windows count
as equal if bucket and hash are, 64 bits and the logarithm of the partition count:
of 1e13 windows in 1e5 partitions some 30 pairs are expected to agree by chance.
Documents are found again by a 64-bit hash of the whole row; rows that share one by
chance (of 1e11, some 270 pairs) would share what is removed.

Skew: a task first counts its own windows. Hashes it holds more than once are
settled there and sent on once, so a passage that millions of documents share
puts at most one entry per block of input into its bucket. Blocks and replies
cross as packed rows, one per block and bucket.

Cases: a null or empty text has no words and keeps none; texts shorter than the
window lose nothing; rows that are equal in every column repeat each other's
windows like any other texts; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm import textkit as tk
from skyloom.llm.work import exchange, pack, partitions, tidy, unpack

WINDOW = 35
#: Words that a task holds before it counts and ships their windows.
BLOCK_WORDS = 1_500_000

_BLOCK = "bucket int, reply boolean, payload binary"
_REPLY = "bucket int, payload binary"
_FOUND = "key long, starts array<int>, stops array<int>"


def _steps(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in document order as (document keys, first entry of each, differences within it)."""
    first = tk.runs(keys)
    step = np.diff(positions, prepend=0)
    step[first] = positions[first]
    return keys[first], first.astype(np.int32), step.astype(np.int32)


def _positions(first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Undo ``_steps``: (document index, position) of each entry."""
    total = np.cumsum(step, dtype=np.int64)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(step))))
    return of, total - (total[first] - step[first])[of]


def _by_document(keys: np.ndarray, positions: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Entries in document order, packed for the buckets that the document keys name."""
    order, bound = tk.split_by(keys % buckets, buckets)
    for k in range(buckets):
        own = order[bound[k] : bound[k + 1]]
        if len(own):
            yield k, pack(*_steps(keys[own], positions[own]))


def _blocks(window: int, buckets: int):
    """Per block of input: packed window hashes by bucket, and positions that the block itself shows to repeat."""
    schema = pa.schema([("bucket", pa.int32()), ("reply", pa.bool_()), ("payload", pa.binary())])

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hashes, bucket, keys, positions = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        if (same & (bucket[order[1:]] != bucket[order[:-1]])).any():
            order = np.lexsort((bucket, hashes))
            same = (hashes[order[1:]] == hashes[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]])
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.append(start, len(order)))
        local = np.zeros(len(hashes), bool)
        local[order[np.repeat(size > 1, size)]] = True
        first = order[start[size > 1]]
        repeated = hashes[first]
        out = [(k, True, x) for k, x in _by_document(keys[local], positions[local], buckets)]
        alone = np.flatnonzero(~local)
        by, bound = tk.split_by(bucket[alone], buckets)
        rep_by, rep_bound = tk.split_by(bucket[first], buckets)
        for k in range(buckets):
            own, rep = alone[by[bound[k] : bound[k + 1]]], repeated[rep_by[rep_bound[k] : rep_bound[k + 1]]]
            if len(own) or len(rep):
                out.append((k, False, pack(hashes[own], rep, *_steps(keys[own], positions[own]))))
        for i in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 500], strict=True), schema.types, strict=True)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in it:
            keys = batch.column("key").to_numpy()
            for a, b, w in tk.batches_of_words(batch, "text"):
                hashes, owner, position = w.windows(window)
                if len(hashes):
                    bucket = (w.second_windows(window) % np.uint64(buckets)).astype(np.int32)
                    held.append((hashes, bucket, keys[a:b][owner], position.astype(np.int32)))
                    words += len(hashes)
                if words >= BLOCK_WORDS:
                    yield from flush(held)
                    held, words = [], 0
        if held:
            yield from flush(held)

    return run


def _count(buckets: int):
    """All blocks of a bucket: which hashes occur again, as positions packed for the documents' buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = []
        for batch in it:
            reply = batch.column("reply").to_numpy(zero_copy_only=False)
            done = batch.filter(batch.column("reply"))
            yield pa.RecordBatch.from_arrays([done.column("bucket"), done.column("payload")], names=["bucket", "payload"])
            packed += [unpack(x.as_py()) for x, r in zip(batch.column("payload"), reply, strict=True) if not r]
        if not packed:
            return
        entries = np.concatenate([x for p in packed for x in (p[0], p[1], p[1])])
        entries.sort()
        again = entries[1:][entries[1:] == entries[:-1]]
        del entries
        again = again[tk.runs(again)]
        keys, positions = [], []
        for hashes, _, key, first, step in packed:
            dup = tk.member(hashes, again)
            of, at = _positions(first, step)
            keys.append(key[of[dup]])
            positions.append(at[dup])
        out = list(_by_document(np.concatenate(keys), np.concatenate(positions), buckets))
        if out:
            k, x = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "payload"])

    return run


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All replies to a bucket's documents: the runs of repeated window starts of each, as [start, stop)."""
    keys, positions = [], []
    for batch in it:
        for x in batch.column("payload"):
            key, first, step = unpack(x.as_py())
            of, at = _positions(first, step)
            keys.append(key[of])
            positions.append(at)
    if not keys:
        return
    key, at = np.concatenate(keys), np.concatenate(positions)
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] > at[:-1] + 1)
    begin = np.flatnonzero(new)
    stop = at[np.append(begin[1:], len(at)) - 1] + 1
    first = tk.runs(key[begin])
    for i in range(0, len(first), 2000):
        a, b = first[i], first[i + 2000] if i + 2000 < len(first) else len(begin)
        cut = first[i : i + 2000] - a
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[begin[first[i : i + 2000]]]), tk.lists(at[begin[a:b]].astype(np.int32), cut), tk.lists(stop[a:b].astype(np.int32), cut)],
            names=["key", "starts", "stops"],
        )


def _removals(window: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            starts, stops = batch.column("starts"), batch.column("stops")
            kept: list[str | None] = []
            n_words, n_removed, digests, spans = [], [], [], []
            for a, b, w in tk.batches_of_words(batch, "text"):
                raw = w.data.tobytes()
                for i in range(a, b):
                    lo, hi = w.first[i - a], w.first[i - a + 1]
                    n = int(hi - lo)
                    keep = np.ones(n, bool)
                    gone: list[dict[str, int]] = []
                    if starts[i].is_valid:
                        change = np.zeros(n + 1, np.int32)
                        change[starts[i].values.to_numpy()] = 1
                        np.subtract.at(change, stops[i].values.to_numpy() + window - 1, 1)
                        covered = np.cumsum(change[:n]) > 0
                        keep = ~covered
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                        gone = [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
                    at = np.flatnonzero(keep) + lo
                    text = b" ".join([raw[x:y] for x, y in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
                    n_words.append(n)
                    n_removed.append(n - len(at))
                    digests.append(hashlib.sha256(text).hexdigest())
                    spans.append(gone)
                    kept.append(text.decode() if gone else None)
            names = ["rest", "text", "n_words", "n_removed", "kept_sha256", "removed", "kept_words"]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind), pa.array(kept, pa.string())],
                names=names,
            )

    return run


def find_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: rest (struct of its other columns), text, n_words, n_removed,
    kept_sha256, removed (maximal intervals of word positions) and kept_words (the kept words
    joined by one space; null where nothing is removed)."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text]
    base = docs.select(
        F.struct(*[docs[c] for c in others]).alias("rest") if others else F.struct(F.lit(0).alias("none")).alias("rest"),
        docs[text].alias("text"),
    ).withColumn("key", F.xxhash64("rest", "text"))
    n = partitions(spark)
    blocks = exchange(base.select("key", "text").mapInArrow(tidy(_blocks(window, n)), _BLOCK))
    repeats = exchange(blocks.mapInArrow(tidy(_count(n)), _REPLY)).mapInArrow(tidy(_merge), _FOUND)
    joined = base.join(repeats, "key", "left").select("rest", "text", "starts", "stops")
    out = T.StructType(
        [
            *base.select("rest", "text").schema,
            *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>, kept_words string"),
        ]
    )
    return joined.mapInArrow(tidy(_removals(window)), out)


def drop_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text (other texts stay as they are) and n_chars, if any, renewed."""
    found = find_repeats(docs, window, text)
    new = F.coalesce("kept_words", "text")
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(new.alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("kept_words").isNull(), F.col("rest")[c]).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("rest")[c].alias(c))
    return found.select(cols)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_repeats(docs)
    return found.select(F.col("rest.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", F.size("removed").cast("long").alias("n_intervals"))
