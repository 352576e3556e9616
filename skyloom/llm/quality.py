"""Document quality: random-indexing word vectors, pooled for each document, and a small network on top.

Words are runs of letters and digits, or runs of other visible characters, as written. Each falls by its hash into one
of ``SLOTS`` slots; a slot's index vector has ``NONZERO`` entries of +1 or -1 at places that its number fixes. A slot's
context vector is the sum of the index vectors of all slots within ``REACH`` words of its own occurrences, counted over
all texts in whole numbers, so it is the same for any order of rows and merges. The table of context vectors has
SLOTS x WIDTH numbers, whatever the corpus.

A document is the mean of its words' unit vectors, the mean of their squares, the mean's length, the mean cosines between
a word and those up to ``REACH`` places on (of stuttering texts they are near 1), and whether it has words at all.
A network with one hidden layer turns that into a logit; it learns from at most ``SAMPLE`` labelled documents, a part of
which is kept back to choose the temperature that makes its probabilities honest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm import textkit as tk
from skyloom.llm.language_id import split
from skyloom.llm.work import exchange, pack, partitions, tidy, unpack

SLOTS, WIDTH, NONZERO, REACH = 1 << 14, 64, 4, 2
#: Packed rows that a task sends at most.
BUCKETS = 128
#: Labelled documents to learn from, at most; one of KEPT_BACK sets the temperature.
SAMPLE, KEPT_BACK = 12_000, 5
HIDDEN, TURNS, RATE, DECAY = 32, 400, 0.01, 1e-3
THRESHOLD = 0.3
FEATURES = 2 * WIDTH + REACH + 2
#: A block of words whose unit vectors are in memory at once.
_AT_ONCE = 1 << 17

_KIND = np.full(256, 1, np.int8)
_KIND[np.arange(0x21, 0x80)] = 2
_KIND[[b for b in range(0x80) if chr(b).isalnum()]] = 1
_KIND[np.frombuffer(tk.WHITESPACE, np.uint8)] = 0


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each word, first word of each text and the end): words are maximal runs of one kind of character."""
    offsets = offsets - offsets[0]
    n, kind = len(data), _KIND[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:n] |= kind[1:] != kind[:-1]
    cut[n] = True
    bounds = np.flatnonzero(cut)
    starts, ends = bounds[:-1], bounds[1:]
    word = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    hashes = tk.spans_hash(tk._BYTE_VALUES[data], tk._BYTE_POWERS, starts, ends)
    return (hashes >> np.uint64(64 - 14)).astype(np.int64), np.searchsorted(starts, offsets, "left")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each SLOTS x NONZERO: where a slot's index vector is not zero, and its values there. Places are distinct."""
    draw = tk.mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(0x51ED)).reshape(SLOTS, NONZERO)
    part = WIDTH // NONZERO
    places = (draw % np.uint64(part)).astype(np.int64) + np.arange(NONZERO) * part
    return places, np.where(draw >> np.uint64(63), 1, -1)


def _contexts(n: int):
    """Per task: the context vectors of the slots of each bucket, as one packed row a bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(SLOTS * WIDTH, np.int64)
        for batch in it:
            data, offsets = tk.text_buffer(batch.column(0))
            for a, b in tk.slices(offsets):
                slot, first = slots(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                owner = np.repeat(np.arange(b - a), np.diff(first))
                for apart in range(1, REACH + 1):
                    left, right = slot[:-apart], slot[apart:]
                    same = owner[:-apart] == owner[apart:]
                    left, right = left[same], right[same]
                    for k in range(NONZERO):
                        for here, there in ((left, right), (right, left)):
                            total += np.bincount(here * WIDTH + places[there, k], signs[there, k], SLOTS * WIDTH).astype(np.int64)
        total = total.reshape(SLOTS, WIDTH)
        size = -(-SLOTS // n)
        used = range(0, SLOTS, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(used)), pa.int32()), pa.array([pack(total[at : at + size]) for at in used], pa.binary())], names=["bucket", "payload"])

    return run


def _add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {}
    for batch in it:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            (values,) = unpack(payload.as_py())
            total[bucket] = total.get(bucket, 0) + values
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x) for x in total.values()], pa.binary())], names=["bucket", "payload"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors (SLOTS x WIDTH) over all texts of ``docs``; a slot without neighbours has zeros."""
    n = min(partitions(docs.sparkSession), BUCKETS)
    schema = "bucket int, payload binary"
    sums = exchange(docs.select(docs[text]).mapInArrow(tidy(_contexts(n)), schema)).mapInArrow(tidy(_add), schema)
    table = np.zeros((SLOTS, WIDTH))
    size = -(-SLOTS // n)
    for row in sums.collect():
        (values,) = unpack(row["payload"])
        table[row["bucket"] * size : (row["bucket"] + 1) * size] = values.reshape(-1, WIDTH)
    length = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return (table / np.maximum(length, 1)).astype(np.float32)


def pool(slot: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features (texts x FEATURES) of texts of words; long texts are summed block by block."""
    n = len(first) - 1
    total = np.zeros((n, 2 * WIDTH + REACH))
    at = 0
    while at < len(slot):
        to = min(at + _AT_ONCE, len(slot))
        ahead = vectors[slot[at : to + REACH]]
        got = ahead[: to - at]
        a, b = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, to, "left")
        inside = np.unique(np.clip(first[a:b], at, None))
        owner = np.searchsorted(first, inside, "right") - 1
        total[owner, :WIDTH] += np.add.reduceat(got, inside - at, axis=0)
        total[owner, WIDTH : 2 * WIDTH] += np.add.reduceat(got * got, inside - at, axis=0)
        left = np.repeat(first[owner + 1], np.diff(np.append(inside, to))) - np.arange(at, to)
        for apart in range(1, REACH + 1):
            alike = np.zeros(to - at)
            then = ahead[apart : apart + to - at]
            alike[: len(then)] = np.einsum("ij,ij->i", got[: len(then)], then)
            alike[left <= apart] = 0
            total[owner, 2 * WIDTH + apart - 1] += np.add.reduceat(alike, inside - at)
        at = to
    count = np.diff(first)[:, None]
    mean = total / np.maximum(count, 1)
    length = np.sqrt((mean[:, :WIDTH] ** 2).sum(axis=1, keepdims=True))
    near = total[:, 2 * WIDTH :] / np.maximum(count - np.arange(1, REACH + 1), 1)
    return np.hstack([mean[:, :WIDTH], mean[:, WIDTH : 2 * WIDTH] * WIDTH, near, length, count == 0])


@dataclass
class Network:
    """Standardisation, two layers, and the temperature of the probabilities."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log likelihood."""
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def learn(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Fit by full-batch Adam on all but each ``KEPT_BACK``-th row, the temperature on those. Without rows the network says 0.5; with one label, that label's smoothed share."""
    if len(y) == 0:
        return Network(np.zeros(FEATURES), np.ones(FEATURES), [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.float64(0)])
    share = (y.sum() + 1) / (len(y) + 2)
    prior = np.float64(np.log(share / (1 - share)))
    kept = np.arange(len(y)) % KEPT_BACK == KEPT_BACK - 1
    fit = ~kept
    centre, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    draw = np.random.default_rng(seed)
    net = Network(centre, scale, [draw.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior])
    if len(np.unique(y[fit])) < 2:
        return net
    z, target = (x[fit] - centre) / scale, y[fit]
    mean, square = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    for turn in range(1, TURNS + 1):
        w1, b1, w2, b2 = net.layers
        hidden = np.tanh(z @ w1 + b1)
        slope = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -60, 60))) - target) / len(target)
        back = slope[:, None] * w2 * (1 - hidden * hidden)
        step = [z.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ slope + DECAY * w2, slope.sum()]
        for i, g in enumerate(step):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            net.layers[i] = net.layers[i] - RATE * (mean[i] / (1 - 0.9**turn)) / (np.sqrt(square[i] / (1 - 0.999**turn)) + 1e-8)
    if len(np.unique(y[kept])) == 2:
        logits = net.logits(x[kept])
        low, high = np.log(0.25), np.log(8.0)
        for _ in range(60):  # the loss has one minimum in 1 / temperature
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if _loss(logits / np.exp(a), y[kept]) < _loss(logits / np.exp(b), y[kept]) else (a, high)
        net.temperature = float(np.exp((low + high) / 2))
    return net


def _features(vectors: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = tk.text_buffer(batch.column("text"))
            rows = [pool(*slots(data[offsets[a] : offsets[b]], offsets[a : b + 1]), vectors) for a, b in tk.slices(offsets)]
            values = np.concatenate([np.zeros((0, FEATURES)), *rows])
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), tk.lists(values.ravel(), np.arange(len(values)) * FEATURES)], names=["draw", "label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE, label: str = "quality") -> Network:
    """The network from at most about ``sample`` labelled documents, drawn by a hash of their ids.

    Several labels of an id are one, the least of them; null ids and labels teach nothing. Equal texts with equal labels
    teach once, so a large group of copies does not outweigh all else.
    """
    known = labels.select(labels["doc_id"].alias("id"), labels[label].cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label")).withColumn("draw", F.xxhash64("id"))
    last = known.orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    chosen = known.where(F.lit(False) if last is None else F.col("draw") <= last)
    drawn = docs.select(docs["doc_id"].alias("id"), docs["text"]).join(F.broadcast(chosen), "id")
    once = drawn.groupBy(F.xxhash64("text").alias("key"), "label").agg(F.min("draw").alias("draw"), F.min("text").alias("text"))
    rows = once.select("draw", "label", "text").mapInArrow(tidy(_features(vectors)), "draw long, label int, x array<double>").orderBy("draw").limit(sample).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), FEATURES)
    return learn(x, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text") -> DataFrame:
    """(rest: struct of the other columns, score) for each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = tk.text_buffer(batch.column("text"))
            rows = [net.probabilities(pool(*slots(data[offsets[a] : offsets[b]], offsets[a : b + 1]), vectors)) for a, b in tk.slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(np.concatenate([np.zeros(0), *rows]))], names=["rest", "score"])

    others = [docs[c] for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    base = docs.select(F.struct(*others).alias("rest"), docs[text].alias("text"))
    return base.mapInArrow(tidy(run), T.StructType([base.schema["rest"], T.StructField("score", T.DoubleType())]))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all texts of ``documents``.

    Null and empty texts score alike, as the labels of texts without words say; a long text is pooled whole, a slice at a
    time; repeated rows score alike; further columns are not read; without labels every score is 0.5; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors = word_vectors(docs)
    teaches = ~split(F.col("doc_id"), 5, 0)
    net = fit(docs.where(teaches), labels.where(teaches), vectors)
    found = score(docs, vectors, net)
    id = F.col("rest.doc_id")
    return found.select(id.alias("doc_id"), split(id, 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
