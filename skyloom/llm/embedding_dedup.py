"""Embedding near-duplicates: exact cosine-threshold pairs by dual cover-tree traversal.

On unit vectors a cosine bound is a distance bound. Equal vectors of a label are one
class. Each label is cut into cells around a few pivots (the top level of its tree),
each cell into blocks of about ``BLOCK`` classes. Two blocks meet in one task unless
their pivots are farther apart than both cell radii and the bound. There, each block
becomes a cover tree: nested levels whose radii halve, every node with the actual
radius of what it covers. Both trees descend together; a node pair goes if the
distance of its centres exceeds both radii and the bound, and counts as a whole if
centres and radii lie within it. Single vectors are decided by the cosine itself.

A task returns, for each class, how many vectors it found linked and the smallest
class it is connected to, so links are counted, never listed.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows without a label, link with nothing and are their own component; vectors of
different lengths are not compared; repeated rows are vectors of their own; a vector
is first divided by a power of two, so very large and very small ones link like others;
a label is any string; other columns are not read; an empty table has no rows. The driver
holds ``SAMPLE`` vectors, then ``PIVOTS``, for each label of more than ``BLOCK`` distinct ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm import textkit as tk
from skyloom.llm.simhash import Forest
from skyloom.llm.work import components, exchange, partitions, stored

COSINE, BLOCK = 0.98, 2048
#: Ids are below this.
NAMELESS = 1 << 62
#: Vectors of a tree node that are no longer split: their pairs are one small product.
LEAF = 32
#: Vectors that a label's pivots are drawn from, and pivots of a label, at most.
SAMPLE, PIVOTS = 256, 64
#: Slack for rounding, so that bounds never decide what the cosine would decide otherwise.
SLACK = 1e-9


class CoverTree:
    """Node arrays over a permutation of unit vectors; node 0 is the root."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.center: list[int] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        todo = [self._node(0, 0, len(x), float(np.sqrt(((x - x[0]) ** 2).sum(1)).max()))]
        level = {0: self.radius[0]}
        while todo:
            node = todo.pop()
            a, b = self.start[node], self.stop[node]
            if b - a <= LEAF or self.radius[node] == 0.0:
                continue
            reach = level[node] / 2
            members = self.order[a:b].copy()
            left, at, made = members, a, []
            lead = self.center[node]
            while len(left):
                d = np.sqrt(((x[left] - x[lead]) ** 2).sum(1))
                d[left == lead] = 0.0
                near = d <= reach
                own = left[near]
                self.order[at : at + len(own)] = own
                child = self._node(lead, at, at + len(own), float(d[near].max()))
                level[child] = reach
                made.append(child)
                at += len(own)
                left = left[~near]
                lead = int(left[0]) if len(left) else -1
            self.children[node] = np.array(made)
            todo += made

    def _node(self, center: int, start: int, stop: int, radius: float) -> int:
        self.center.append(center)
        self.start.append(start)
        self.stop.append(stop)
        self.radius.append(radius)
        self.children.append(np.zeros(0, np.int64))
        return len(self.center) - 1

    def freeze(self) -> CoverTree:
        for name in ("center", "start", "stop", "radius"):
            setattr(self, name, np.array(getattr(self, name)))
        return self


def dual_join(raw_a: np.ndarray, weight_a: np.ndarray, raw_b: np.ndarray | None, weight_b: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted by class size) and component labels of all vectors of a, then of b; without b, of a with itself."""
    norm = lambda v: np.sqrt((v * v).sum(1))
    na = norm(raw_a)
    xa = raw_a / na[:, None]
    ta = CoverTree(xa).freeze()
    alone = raw_b is None
    if alone:
        raw_b, weight_b, nb, xb, tb, base = raw_a, weight_a, na, xa, ta, 0
    else:
        nb = norm(raw_b)
        xb = raw_b / nb[:, None]
        tb, base = CoverTree(xb).freeze(), len(raw_a)
    n = len(raw_a) + (0 if alone else len(raw_b))
    links, forest = np.zeros(n, np.int64), Forest(n)
    bound = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        itself = alone and a == b
        ca = ta.children[a] if len(ta.children[a]) else np.array([a])
        cb = tb.children[b] if len(tb.children[b]) else np.array([b])
        if itself and len(ca) == 1 and ca[0] == a:
            # A node without children: decide every pair.
            own = ta.order[ta.start[a] : ta.stop[a]]
            if len(own) > 1:
                dot = raw_a[own] @ raw_a[own].T / (na[own][:, None] * na[own][None, :])
                i, j = np.nonzero(np.triu(dot >= cosine, 1))
                np.add.at(links, own[i], weight_a[own[j]])
                np.add.at(links, own[j], weight_a[own[i]])
                forest.link(own[i], own[j])
            continue
        for k in range(0, len(ca), 1024):
            part = ca[k : k + 1024]
            d = xa[ta.center[part]] @ xb[tb.center[cb]].T
            np.multiply(d, -2.0, out=d)
            d += 2.0
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            spread = ta.radius[part][:, None] + tb.radius[cb][None, :]
            # The distance from a rounded cosine is off by up to the root of the rounding.
            slack = SLACK + 3e-8
            open_ = d <= bound + spread + slack
            if itself:
                open_ &= np.arange(len(cb))[None, :] >= np.arange(k, k + len(part))[:, None]
            i, j = np.nonzero(open_)
            pa_, pb_ = part[i], cb[j]
            same = itself & (pa_ == pb_)
            single = (ta.stop[pa_] - ta.start[pa_] == 1) & (tb.stop[pb_] - tb.start[pb_] == 1) & ~same
            sure = (d[i, j] + spread[i, j] <= bound - slack) & ~same & ~single
            for p, q in zip(pa_[sure].tolist(), pb_[sure].tolist(), strict=True):
                u, v = ta.order[ta.start[p] : ta.stop[p]], tb.order[tb.start[q] : tb.stop[q]]
                links[u] += weight_b[v].sum()
                links[v + base] += weight_a[u].sum()
                forest.link(np.concatenate([u, v + base]), np.full(len(u) + len(v), u[0]))
            u, v = ta.center[pa_[single]], tb.center[pb_[single]]
            for s in range(0, len(u), 65536):
                x, y = u[s : s + 65536], v[s : s + 65536]
                hit = (raw_a[x] * raw_b[y]).sum(1) / (na[x] * nb[y]) >= cosine
                x, y = x[hit], y[hit]
                np.add.at(links, x, weight_b[y])
                np.add.at(links, y + base, weight_a[x])
                forest.link(x, y + base)
            rest = ~sure & ~single & ~(same & (ta.stop[pa_] - ta.start[pa_] == 1))
            for p, q in zip(pa_[rest].tolist(), pb_[rest].tolist(), strict=True):
                if p == a and q == b and not itself:
                    # Two nodes without children: decide every pair.
                    u, v = ta.order[ta.start[p] : ta.stop[p]], tb.order[tb.start[q] : tb.stop[q]]
                    dot = raw_a[u] @ raw_b[v].T / (na[u][:, None] * nb[v][None, :])
                    i2, j2 = np.nonzero(dot >= cosine)
                    np.add.at(links, u[i2], weight_b[v[j2]])
                    np.add.at(links, v[j2] + base, weight_a[u[i2]])
                    forest.link(u[i2], v[j2] + base)
                else:
                    todo.append((p, q))
    return links, forest.label


def _vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, key, vec): doubles as bytes and their digest; null for vectors that link with nothing."""
    for batch in it:
        keys, vecs = [], []
        for label, value in zip(batch.column("label").to_pylist(), batch.column("vec"), strict=True):
            v = None
            if label is not None and value.is_valid and value.values.null_count == 0 and len(value.values):
                v = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                most = float(np.abs(v).max()) if np.isfinite(v).all() else 0.0
                # The power of two below the largest component goes: exact, and no square leaves the range of doubles.
                v = np.ldexp(v, 1 - int(np.frexp(most)[1])) + 0.0 if most > 0 else None
            vecs.append(None if v is None else v.tobytes())
            name = (label or "").encode()
            keys.append(None if v is None else hashlib.sha256(len(name).to_bytes(8, "big") + name + vecs[-1]).digest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "label", "key", "vec"])


def _unit(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def choose_pivots(classes: DataFrame, sample: int = SAMPLE, most: int = PIVOTS, block: int = BLOCK) -> dict[tuple[str, int], np.ndarray]:
    """Per (label, bytes): pivots of a bounded sample, each farthest from those before, one for each block the group needs."""
    sizes = {(r[0], r[1]): r[2] for r in classes.groupBy("label", F.length("vec").alias("bytes")).count().where(F.col("count") > block).collect()}
    if not sizes:
        return {}
    big = F.broadcast(classes.sparkSession.createDataFrame(list(sizes), "label string, bytes int"))
    drawn = classes.select("label", "vec", F.length("vec").alias("bytes")).join(big, ["label", "bytes"], "left_semi")
    # Of every label, so that none is left with a point far from all of its own.
    first = Window.partitionBy("label", "bytes").orderBy(F.xxhash64("vec"), "vec")
    by: dict[tuple[str, int], list[bytes]] = {}
    for label, vec in drawn.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).select("label", "vec").collect():
        by.setdefault((label, len(vec)), []).append(bytes(vec))
    out = {}
    for group, n in sizes.items():
        x = _unit(by[group])
        chosen = [0]
        far = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(most, len(x), -(-n // block)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[group] = x[chosen]
    return out


def _cells(pivots: dict[tuple[str, int], np.ndarray]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            labels, vecs = batch.column("label").to_pylist(), batch.column("vec").to_pylist()
            cell, far = np.full(len(vecs), -1, np.int32), np.zeros(len(vecs))
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (label, vec) in enumerate(zip(labels, vecs, strict=True)):
                groups.setdefault((label, len(vec)), []).append(i)
            for group, rows in groups.items():
                if group in pivots:
                    x = _unit([vecs[i] for i in rows])
                    d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots[group].T))
                    cell[rows], far[rows] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("label"), batch.column("n"), batch.column("vec"), pa.array(cell), pa.array(far)], names=["cid", "label", "n", "vec", "cell", "far"]
            )

    return run


def _meetings(pivots, cells: dict[tuple[str, int, int], tuple[int, float]], cosine: float, block: int, buckets: int):
    """A copy of each class for each block pair it takes part in, keyed by the pair."""
    bound = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    parts = {c: -(-n // block) for c, (n, _) in cells.items()}
    meets: dict[tuple[str, int, int], list[int]] = {}
    for (label, size, cell), (_, radius) in cells.items():
        p = pivots[label, size]
        meets[label, size, cell] = [
            c
            for c in range(len(p))
            if (label, size, c) in cells and float(np.sqrt(((p[cell] - p[c]) ** 2).sum())) <= radius + cells[label, size, c][1] + bound + 1e-6
        ]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            task, side, row = [], [], []
            cid = batch.column("cid").to_numpy()
            sub = tk.mix(cid.view(np.uint64))
            for i, (label, cell, vec) in enumerate(zip(batch.column("label").to_pylist(), batch.column("cell").to_pylist(), batch.column("vec"), strict=True)):
                size = len(vec.as_py())
                # A group that fits one block is one task.
                own = (cell, int(sub[i]) % parts.get((label, size, cell), 1))
                for c in meets.get((label, size, cell), [cell]):
                    for s in range(parts.get((label, size, c), 1)):
                        low, high = sorted([own, (c, s)])
                        task.append(f"{low[0]}.{low[1]}/{high[0]}.{high[1]}/{size}/{label}")
                        side.append(0 if own == low else 1)
                        row.append(i)
            for a in range(0, len(row), 20_000):
                at = pa.array(row[a : a + 20_000])
                key = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in task[a : a + 20_000]]
                bucket = (np.frombuffer(b"".join(key), np.uint64) % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(task[a : a + 20_000]), pa.array(side[a : a + 20_000], pa.int32()), *(batch.column(c).take(at) for c in ("cid", "n", "vec"))],
                    names=["bucket", "task", "side", "cid", "n", "vec"],
                )

    return run


def _join(cosine: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            side = np.concatenate([b.column("side").to_numpy() for b in held])
            cid = np.concatenate([b.column("cid").to_numpy() for b in held])
            n = np.concatenate([b.column("n").to_numpy() for b in held])
            raw = np.concatenate([np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float64).reshape(b.num_rows, -1) for b in held])
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            # Labels come last, as they may hold anything.
            first, second = current.split("/", 2)[:2]
            if first != second and not (len(one) and len(two)):
                return
            if first == second:
                links, label = dual_join(raw, n, None, None, cosine)
                order = np.arange(len(cid))
            else:
                links, label = dual_join(raw[one], n[one], raw[two], n[two], cosine)
                order = np.concatenate([one, two])
            ids = cid[order]
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids)
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(low[label[at]])], names=["cid", "links", "low"])

        for batch in it:
            names = batch.column("task").to_pylist()
            cut = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(cut, cut[1:], strict=False):
                if names[a] != current and held:
                    yield from flush()
                    held = []
                current = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other vectors linked), component (smallest id reachable).

    A vector without an id is a vector like others: it counts, links and connects, but gives a component no name; a component
    without any id is null. Ids are below 2**62.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    base = vectors.select(vectors[id].cast("long").alias("id"), vectors[label].cast("string").alias("label"), vectors[vec].cast("array<double>").alias("vec"))
    keyed = base.mapInArrow(_vectors, "id long, label string, key binary, vec binary")
    # A class of vectors without ids goes by a hash, beyond all ids.
    name = F.coalesce(F.min("id"), F.lit(NAMELESS) + F.min(F.xxhash64("key")).bitwiseAND(NAMELESS - 1))
    classes = stored(keyed.where("key is not null").groupBy("key").agg(name.alias("cid"), F.min("label").alias("label"), F.count("*").alias("n"), F.min("vec").alias("vec")), "vectors")
    pivots = choose_pivots(classes, block=block)
    placed = stored(classes.select("cid", "label", "n", "vec").mapInArrow(_cells(pivots), "cid long, label string, n long, vec binary, cell int, far double"), "cells")
    # One row per pivot: a label has PIVOTS at most, and only if it fills more than one block.
    cells = {(r[0], r[1], r[2]): (r[3], r[4]) for r in placed.where("cell >= 0").groupBy("label", F.length("vec").alias("bytes"), "cell").agg(F.count("*"), F.max("far")).collect()}
    meetings = placed.mapInArrow(_meetings(pivots, cells, cosine, block, n), "bucket int, task string, side int, cid long, n long, vec binary")
    found = stored(exchange(meetings).sortWithinPartitions("task").mapInArrow(_join(cosine), "cid long, links long, low long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")))
    classified = (
        classes.select("key", "cid", "n")
        .join(links, "cid", "left")
        .join(root, F.col("cid") == root["node"], "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component"))
        .withColumn("component", F.when(F.col("component") < NAMELESS, F.col("component")))
        .withColumn("linked", F.lit(True))
    )
    return keyed.select("id", "key").join(classified, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("id")).alias("component"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
