"""Density clusters of vectors: the hierarchy of mutual reachability, condensed, and its most stable clusters.

Definitions. The core distance of a point is the distance to its k-th nearest point, itself counted. Two points reach each
other at the greatest of their distance and both core distances. Joining points in order of reach gives a hierarchy; a group
of ``least`` points or more is a cluster, which is born when small groups make one, takes in small groups, and ends when it
meets another cluster, as both become parts of a larger one. With density 1/reach, a cluster's stability is the sum over
its points of the densities between its end and the point's coming. The chosen clusters do not overlap and have the
greatest sum of stabilities; the cluster of everything is never chosen. All other points are noise.

How Spark does it. (1) Equal vectors are one point. Blocks of points meet in a product of partitions, which ships nothing: each point lists its
nearest ones, which gives core distances. (2) Rounds of least outgoing edges (Boruvka) take the spanning tree from the lists, where these prove
an edge to be the least; points that they leave in doubt search all others. So disk grows with the points, only products with their pairs. (3) The tree's edges in order are cut into segments; each segment learns the sizes of
the groups that earlier ones make by halving: the lower half of a range, contracted, is where the upper half begins. Then every
segment tells, by itself, which edges make small groups, clusters, or join clusters. (4) The joins of clusters, at most
rows / ``least``, are the condensed tree; the driver chooses from it, and points find their cluster in it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.kernels import connected
from skyloom.session import shared_folder

#: Points of a block, on average, and edges of a segment.
BLOCK, SEGMENT = 4096, 1 << 18
#: Rows of one matrix product, and pairs measured at once.
TILE, MEASURED = 256, 1 << 14
#: Tasks for each core in which blocks meet, and points that are listed beyond the k-th nearest.
TASKS, MORE = 3, 9
#: The id of no point; distances may be infinite where squares overflow.
NONE = np.iinfo(np.int64).max
#: The share of the least squared reach in sight that single precision may blur.
ROUGH = 1e-3
#: A group in so many, at least, must know its least edge from the lists, or points search again.
KNOWN = 32
#: The nearest points that make the default core distance, at most.
NEIGHBOURS = 15
#: Reaches below this count as this, so that copies have a density.
LEAST_REACH = 1e-100

SMALL, TAKEN, BORN, JOINED = 0, 1, 2, 3
_EDGE = "a long, b long, w double"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def squares(xt: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of the columns of ``xt`` to ``x``, dimension by dimension: the same for a pair in any block."""
    out = np.zeros(xt.shape[1])
    for row, value in zip(xt, x, strict=True):
        apart = row - value
        out += apart * apart
    return out


def _slack(lengths: np.ndarray, size: int, kind: type = float) -> np.ndarray:
    """Twice this, for two squared lengths, is more than matrix products and ``squares`` can differ by for vectors of ``size`` numbers; infinite where they may overflow."""
    most = 1e300 if kind is float else 1e30
    out = 8 * (size + 8) * float(np.finfo(kind).eps) * lengths + 1 / most
    out[~(lengths < most)] = np.inf
    return out


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``squares`` of rows, bit for bit: sums go from dimension to dimension."""
    apart = x - y
    apart *= apart
    return np.cumsum(apart, axis=1)[:, -1]


def least_distances(xt: np.ndarray, yt: np.ndarray, k: int) -> np.ndarray:
    """(columns of xt, min(k, columns of yt)): the least distances to the columns of ``yt``, in order.

    Matrix products tell which columns can be among them; those are measured by ``squares``.
    """
    k = min(k, yt.shape[1])
    if not k or not xt.shape[0]:
        return np.zeros((xt.shape[1], k))
    x, y = np.ascontiguousarray(xt.T), np.ascontiguousarray(yt.T)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    sx, sy = _slack(xx, x.shape[1]), _slack(yy, x.shape[1])
    out = np.empty((len(x), k))
    for at in range(0, len(x), TILE):
        own = slice(at, at + TILE)
        with np.errstate(over="ignore", invalid="ignore"):
            far = x[own] @ (-2.0 * yt)
            far += xx[own, None]
            far += yy
            # The k-th of the upper bounds is one that the k-th distance does not pass.
            reach = far + sy
            reach = np.partition(reach, k - 1, axis=1)[:, k - 1] + 2 * sx[own]
            far -= sy
            i, j = np.nonzero(~(far > reach[:, None]))
        if not np.isfinite(reach).all():
            out[own] = [np.sort(np.partition(squares(yt, v), k - 1)[:k]) for v in x[own]]
            continue
        d = np.concatenate([_exact(x[own][i[s : s + MEASURED]], y[j[s : s + MEASURED]]) for s in range(0, len(i), MEASURED)])
        order = np.lexsort((d, i))
        out[own] = d[order][np.searchsorted(i, np.arange(len(reach)))[:, None] + np.arange(k)]
    return np.sqrt(out)


def spanning_tree(xt: np.ndarray, core: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, reach) of the edges of the least spanning tree, a < b; equal reaches go by (a, b), so all blocks agree on one tree.

    One matrix product gives a lower bound of every distance; only what may then come nearer is measured by ``squares``.
    """
    n = len(ids)
    out, reach = np.zeros((max(n - 1, 0), 2), np.int64), np.zeros(max(n - 1, 0))
    far, low, high = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    away, at = np.ones(n, bool), 0
    x = np.ascontiguousarray(xt.T)
    lengths = (x * x).sum(1)
    slack = _slack(lengths, x.shape[1])
    least = np.empty((n, n))
    for s in range(0, n, TILE):
        own = slice(s, s + TILE)
        with np.errstate(over="ignore", invalid="ignore"):
            part = np.matmul(x[own] * -2.0, xt, out=least[own])
            part += (lengths - slack)[own, None]
            part += lengths - slack
            np.sqrt(np.fmax(part, 0.0, out=part), out=part)
    # ``left`` is ``far`` without the points that are in the tree.
    left, both = far.copy(), np.empty(n)
    for step in range(n - 1):
        away[at], left[at] = False, np.inf
        np.maximum(core, core[at], out=both)
        np.maximum(both, least[at], out=both)
        near = np.flatnonzero((both <= far) & away)
        if len(near):
            w = np.sqrt(np.concatenate([_exact(x[near[s : s + MEASURED]], x[at]) for s in range(0, len(near), MEASURED)]))
            w = np.maximum(np.maximum(w, core[near]), core[at])
            a, b = np.minimum(ids[near], ids[at]), np.maximum(ids[near], ids[at])
            old = far[near]
            nearer = (w < old) | ((w == old) & ((a < low[near]) | ((a == low[near]) & (b < high[near]))))
            near = near[nearer]
            far[near], low[near], high[near] = w[nearer], a[nearer], b[nearer]
            left[near] = w[nearer]
        nearest = left.min()
        ties = np.flatnonzero(left == nearest) if nearest < np.inf else np.flatnonzero(away)
        at = ties[np.lexsort((high[ties], low[ties]))[0]] if len(ties) > 1 else ties[0]
        out[step], reach[step] = (low[at], high[at]), far[at]
    return out[:, 0], out[:, 1], reach


def _columns(table: pa.Table, name: str = "vec") -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(table.num_rows, -1).T)


def _one_tree(k: int):
    """The tree of few points, in one place."""

    def run(table: pa.Table) -> pa.Table:
        x = _columns(table)
        a, b, w = spanning_tree(x, least_distances(x, x, k)[:, -1], table.column("node").to_numpy())
        return pa.table({"a": a, "b": b, "w": w})

    return run


#: Products in single precision, a third of the time, tell as much as those in double where points are not very near for their lengths.
_KINDS = (float, np.float32)
_PACKED = {"node": np.int64, "times": np.int64, "core": np.float64, "comp": np.int64, "vec": np.float64}


def _pack(table: pa.Table) -> pa.Table:
    """A block as one row, so that blocks can meet as they are."""
    table = table.sort_by("node")
    names = [c for c in table.column_names if c in _PACKED]
    whole = {c: table.column(c).combine_chunks() for c in names}
    flat = {c: (v.flatten() if c == "vec" else v).to_numpy(zero_copy_only=False) for c, v in whole.items()}
    return pa.table({"part": table.column("part")[:1], **{c: pa.array([flat[c].astype(_PACKED[c]).tobytes()], pa.binary()) for c in names}})


class _Block:
    """The points of a packed row."""

    def __init__(self, batch: pa.RecordBatch, row: int, prefix: str):
        for c, kind in _PACKED.items():
            if prefix + c in batch.schema.names:
                setattr(self, c, np.frombuffer(batch.column(prefix + c)[row].as_buffer(), kind))
        self.vec = self.vec.reshape(len(self.node), -1)
        self.squared = (self.vec * self.vec).sum(1)
        self.slack = {kind: _slack(self.squared, self.vec.shape[1], kind) for kind in _KINDS}

    def as_rows(self) -> dict[type, np.ndarray]:
        with np.errstate(over="ignore"):
            return {kind: np.concatenate([self.vec * -2.0, np.ones((len(self.vec), 1))], axis=1).astype(kind) for kind in _KINDS}

    def as_columns(self) -> dict[type, np.ndarray]:
        """``as_rows`` times this, and the rows' squared lengths without their slack, is less than any squared distance."""
        with np.errstate(over="ignore", invalid="ignore"):
            return {kind: np.concatenate([self.vec, (self.squared - self.slack[kind])[:, None]], axis=1).T.astype(kind, order="C") for kind in _KINDS}


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of few places in a table, eight at a time."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.nonzero(mask)
    some = np.flatnonzero(flat.view(np.uint64))
    at = (some[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[flat[at]], mask.shape[1])


class _Kept:
    """For each point of a block the least edges to points that it has met, in order: (distance, id), or (reach, least id, greatest id) if groups are known.

    Without groups ``most`` points are kept, else the least edge that leaves the point's group.
    """

    def __init__(self, block: _Block, most: int):
        self.own, self.most, n = block, most, len(block.node)
        self.rows = block.as_rows()
        self.w = np.full((n, most), np.inf)
        self.to = np.full((n, most), NONE)
        self.extra = np.zeros((n, most), np.int64)  # how many equal points there are, or the group

    def meet(self, other: _Block, columns: dict[type, np.ndarray]) -> None:
        grouped = hasattr(other, "comp")
        room = {kind: np.empty((TILE, len(other.node)), kind) for kind in _KINDS}
        rough = other.slack[np.float32].max()
        for at in range(0, len(self.own.node), TILE):
            own = slice(at, at + TILE)
            with np.errstate(over="ignore", invalid="ignore"):
                reach = self.w[own, -1] ** 2
                kind = np.float32 if reach.max() < np.inf and self.own.slack[np.float32][own].max() + rough < ROUGH * reach.min() else float
                base, give = self.own.squared[own], self.own.slack[kind][own]
                part = np.matmul(self.rows[kind][own], columns[kind], out=room[kind][: len(base)])
                bar = reach * (1 + 1e-15) - base + give
                unmet = np.flatnonzero(~(reach < np.inf))
                if len(unmet):
                    bar[unmet] = np.fmin(bar[unmet], self._first_bar(part, unmet, at, other, grouped))
                if kind is np.float32:
                    bar = np.nextafter(bar.astype(kind), np.inf, dtype=kind)
                i, j = _places(~(part > bar[:, None]))
            i += at
            if grouped:
                use = (self.own.comp[i] != other.comp[j]) & (other.core[j] <= self.w[i, -1])
            else:
                use = self.own.node[i] != other.node[j]
            if use.any():
                self._merge(i[use], j[use], other, grouped)

    def _first_bar(self, part, unmet, at, other, grouped):
        """An upper bound, as ``bar``, for rows that have not met enough points: the upper bounds of these columns tell it."""
        upper, twice = part[unmet] + 2 * other.slack[float], 2 * self.own.slack[float][unmet + at]
        if not grouped:
            if upper.shape[1] <= self.most:
                return np.full(len(unmet), np.inf)
            # A point may be among the columns itself.
            return np.partition(upper, self.most, axis=1)[:, self.most] + twice
        rest = self.own.squared[unmet + at] - self.own.slack[float][unmet + at]
        reach = np.maximum(np.maximum(upper + (rest + twice)[:, None], other.core**2), self.own.core[unmet + at, None] ** 2)
        reach[self.own.comp[unmet + at, None] == other.comp] = np.inf
        reach[np.isnan(reach)] = np.inf
        return reach.min(axis=1) * (1 + 1e-15) - rest

    def _merge(self, i, j, other, grouped):
        d = np.sqrt(np.concatenate([_exact(self.own.vec[i[s : s + MEASURED]], other.vec[j[s : s + MEASURED]]) for s in range(0, len(i), MEASURED)]))
        if grouped:
            d = np.maximum(np.maximum(d, self.own.core[i]), other.core[j])
        near = d <= self.w[i, -1]
        i, j, d = i[near], j[near], d[near]
        if not len(i):
            return
        hit = np.unique(i)
        row = np.concatenate([np.repeat(hit, self.most), i])
        w = np.concatenate([self.w[hit].ravel(), d])
        to = np.concatenate([self.to[hit].ravel(), other.node[j]])
        extra = np.concatenate([self.extra[hit].ravel(), (other.comp if grouped else other.times)[j]])
        if grouped:
            ends = self.own.node[row]
            order = np.lexsort((np.maximum(to, ends), np.minimum(to, ends), w, row))
        else:
            order = np.lexsort((to, w, row))
        first = np.searchsorted(row[order], hit)
        kept = order[first[:, None] + np.arange(self.most)]
        self.w[hit], self.to[hit], self.extra[hit] = w[kept], to[kept], extra[kept]

    def told(self, part: int) -> pa.RecordBatch:
        offsets = pa.array(np.arange(0, self.w.size + 1, self.most, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in (self.w, self.to, self.extra)]
        own = pa.array(self.own.times if hasattr(self.own, "times") else np.ones(len(self.w), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self.w), part, np.int32)), pa.array(self.own.node), own, *lists], names=["part", "node", "times", "w", "to", "extra"])


_MET = "part int, node long, times long, w array<double>, to array<long>, extra array<long>"


def _meet(most: int):
    """Takes pairs of packed rows and keeps the least edges of each left block; of the other blocks it holds one at a time."""

    def run(it):
        kept = {}
        for batch in it:
            for row in range(batch.num_rows):
                part = batch.column("part")[row].as_py()
                if part not in kept:
                    kept[part] = _Kept(_Block(batch, row, ""), most)
                other = _Block(batch, row, "to_")
                kept[part].meet(other, other.as_columns())
        for part, state in kept.items():
            yield state.told(part)

    return run


def _listed(k: int, most: int):
    """Of a block's lists the nearest points, core distances, and what no edge to a point that is not listed comes before."""
    low = pa.struct([("w", pa.float64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, first, times = np.unique(table.column("node").to_numpy(), return_index=True, return_counts=True)
        own = table.column("times").to_numpy()[first]
        row = np.repeat(np.arange(len(node)), times * most)
        d, to, count = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("w", "to", "extra"))
        order = np.lexsort((to, d, row))
        kept = order[np.searchsorted(row[order], np.arange(len(node)))[:, None] + np.arange(most)]
        d, to, count = d[kept], to[kept], count[kept]
        # The point and its copies are at no distance.
        at = (own[:, None] + np.cumsum(count, axis=1) >= k).argmax(axis=1)
        core = np.where(own >= k, 0.0, d[np.arange(len(node)), at])
        every = to[:, -1] == NONE
        past = np.where(every, 0, to[:, -1]) + 1
        ends = [pa.array(d[:, -1]), pa.array(np.minimum(node, past)), pa.array(np.maximum(node, past))]
        bound = pa.StructArray.from_arrays(ends, fields=list(low), mask=pa.array(every))
        offsets = pa.array(np.concatenate([[0], np.cumsum((to < NONE).sum(axis=1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[to < NONE])) for v in (d, to)]
        return pa.table([pa.array(node), pa.array(core), bound, *lists], names=["node", "core", "low", "d", "to"])

    return run


def _numbered(stored: DataFrame, mid: str, name: str) -> DataFrame:
    """Replaces ``monotonically_increasing_id`` as written by numbers without gaps, in the same order."""
    part = F.shiftright(mid, 33)
    sizes = {r["p"]: r["count"] for r in stored.groupBy(part.alias("p")).count().collect()}
    begin, total = {}, 0
    for p in sorted(sizes):
        begin[p], total = total, total + sizes[p]
    if not begin:
        return stored.withColumn(name, F.col(mid)).drop(mid)
    starts = stored.sparkSession.createDataFrame(list(begin.items()), "p long, begin long")
    return stored.join(F.broadcast(starts), part == F.col("p")).withColumn(name, F.col("begin") + F.col(mid).bitwiseAND((1 << 33) - 1)).drop(mid, "p", "begin")


class _Tables:
    """Tables that cut lineage, in one shared folder."""

    def __init__(self, spark):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/skyloom/density-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.folder}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        # The table replaces all that led to it, shuffle files too.
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._density_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of ``keep`` that is not read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._density_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def packed(self, points: DataFrame, n: int, block: int) -> DataFrame:
        """``points`` (node, vec, ...) in blocks, each a row; in so many files that all cores read some."""
        cores = self.spark.sparkContext.defaultParallelism
        blocks = max(1, -(-n // block), min(cores, -(-n // 256)))
        rows = points.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
        names = [c for c in points.columns if c in _PACKED]
        rows = rows.select("part", *names).groupBy("part").applyInArrow(_pack, ", ".join(["part int", *(f"{c} binary" for c in names)]))
        files = min(blocks, cores)
        return self.keep(rows.repartitionById(files, F.pmod("part", F.lit(files)).cast("int")))

    def met(self, left: DataFrame, right: DataFrame, most: int) -> DataFrame:
        """Every left block meets every right block.

        A product of the two tables' partitions, which reads their files again and ships nothing. Pairs with the same left blocks
        follow each other, so a task keeps lists for its left blocks and the lists grow with the points, not with the pairs.
        """
        pairs = left.crossJoin(right.select(*[F.col(c).alias(f"to_{c}") for c in right.columns if c != "part"]).hint("shuffle_replicate_nl"))
        return pairs.coalesce(TASKS * self.spark.sparkContext.defaultParallelism).mapInArrow(_meet(most), _MET)

    def components(self, edges: DataFrame, a: str, b: str) -> DataFrame:
        return self.keep(connected(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")), self.path()))


def _tree(points: DataFrame, n: int, k: int, block: int, tables: _Tables) -> tuple[DataFrame, DataFrame]:
    """The least spanning tree (a, b, w) of distinct points (node, vec, times), ties by (a, b), and core distances (node, core).

    Every point lists its nearest ones, and knows what no edge to another comes before. A group's least edge out is an edge of the tree; it is
    known if it does not come after what any of the group's points knows. When lists tell too few, the points that stand in doubt search all others
    for the least edge out of their group, but for those of one group, which the others reach.
    """
    packed = tables.packed(points, n, block)
    most = k + MORE
    listed = tables.met(packed, packed, most).groupBy("part").applyInArrow(_listed(k, most), "node long, core double, low struct<w double, a long, b long>, d array<double>, to array<long>")
    listed = tables.keep(listed)
    cores = listed.select("node", "core")
    near = listed.select("node", "core", F.explode(F.arrays_zip("d", "to")).alias("near")).select("node", "core", "near.d", "near.to")
    near = near.join(cores.select(F.col("node").alias("to"), F.col("core").alias("other")), "to")
    edge = F.struct(F.greatest("d", "core", "other").alias("w"), F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).alias("e")
    now = near.select(edge).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"), "e")
    where = tables.keep(listed.select("node", F.col("node").alias("comp"), "low"))
    cores = tables.keep(cores)
    found, last = None, listed
    while True:
        # Of parallel edges between two groups the least stays.
        now = tables.keep(now.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("e").alias("e")))
        if last is not None:
            tables.drop(last)
        last = now
        both = now.select("u", "e", F.col("v").alias("y")).union(now.select("v", "e", "u"))
        best = both.groupBy(F.col("u").alias("comp")).agg(F.min(F.struct("e", "y")).alias("best"))
        state = where.groupBy("comp").agg(F.min("low").alias("least")).join(best, "comp", "left")
        known = F.col("best").isNotNull() & (F.col("least").isNull() | (F.col("best.e") <= F.col("least")))
        state = tables.keep(state.select("comp", F.col("best.e").alias("e"), F.col("best.y").alias("y"), known.alias("known")))
        groups, sure = state.agg(F.count("*"), F.count_if("known")).first()
        if groups < 2:
            return (found if found is not None else points.sparkSession.createDataFrame([], _EDGE)), cores
        if sure * KNOWN < groups:
            doubt = where.join(state.where("not known").select("comp", "e"), "comp")
            doubt = tables.keep(doubt.where(F.col("low").isNotNull() & (F.col("e").isNull() | (F.col("low") < F.col("e")))).select("node", "comp"))
            largest = doubt.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()["comp"]
            asked = doubt.where(F.col("comp") != largest)
            whole = points.select("node", "vec").join(cores, "node").join(where.select("node", "comp"), "node")
            left = tables.packed(whole.join(asked.select("node"), "node", "left_semi"), asked.count(), block)
            right = tables.packed(whole, n, block)
            out = tables.met(left, right, 1).select("node", F.col("w")[0].alias("w"), F.col("to")[0].alias("to"), F.col("extra")[0].alias("v")).where(F.col("to") < NONE)
            edge = F.struct("w", F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"))
            out = tables.keep(out.groupBy("node").agg(F.min(F.struct(edge.alias("e"), "v")).alias("out")).select("node", "out.e", "out.v"))
            out = out.join(asked, "node")
            now = now.unionByName(out.select(F.col("comp").alias("u"), "v", "e"))
            new = asked.select("node", F.lit(True).alias("asked")).join(out.select("node", "e"), "node", "left")
            changed = where.join(new, "node", "left").select("node", "comp", F.when(F.col("asked"), F.col("e")).otherwise(F.col("low")).alias("low"))
            old, where = where, tables.keep(changed)
            for done in (old, left, right, state):
                tables.drop(done)
            continue
        chosen = tables.keep(state.where("known").select("comp", "y", "e.*"))
        edges = chosen.select("a", "b", "w").distinct()
        found = edges if found is None else found.union(edges)
        root = tables.components(chosen, "comp", "y")
        moved = where.join(root.select(F.col("node").alias("comp"), "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"), "low")
        for end in ("u", "v"):
            now = now.join(root.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        old, where = where, tables.keep(moved)
        tables.drop(old)
        tables.drop(state)


def _with_copies(tree: DataFrame, cores: DataFrame, points: DataFrame, good: DataFrame) -> DataFrame:
    """The tree of all points of ``good``, from that of the distinct ones.

    All edges of a point are as long as its core distance, at least; a copy's least such edge goes to the least point that has one, a copy of its own or a
    point before them. That is a leaf of the tree of all, and the least edge of the copies' first point tells it.
    """
    ends = tree.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").union(tree.select("b", "a", "w"))
    ends = ends.join(cores, "node").where((F.col("w") == F.col("core")) & (F.col("other") < F.col("node"))).groupBy("node").agg(F.min("other").alias("other"))
    many = points.where("times > 1").join(cores, "node").join(ends, "node", "left")
    many = many.select("vec", F.col("node").alias("first"), F.coalesce("other", "node").alias("a"), F.col("core").alias("w"))
    return tree.union(good.join(many, "vec").where("node <> first").select("a", F.col("node").alias("b"), "w"))


def _judge(least: int):
    """Joins groups along the edges of a segment in order and tells what each edge does, and the edge's end in a small group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        u, v, su, sv = (table.column(c).to_pylist() for c in ("u", "v", "su", "sv"))
        up, size = {}, {}
        for x, s in (*zip(u, su, strict=True), *zip(v, sv, strict=True)):
            up[x], size[x] = x, s
        kind = np.zeros(len(u), np.int8)
        end = [None] * len(u)

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        for i, (x, y) in enumerate(zip(u, v, strict=True)):
            x, y = top(x), top(y)
            one, two = size[x] >= least, size[y] >= least
            if one and two:
                kind[i] = JOINED
            elif one or two:
                kind[i], end[i] = TAKEN, b[i] if one else a[i]
            elif size[x] + size[y] >= least:
                kind[i] = BORN
            if size[x] < size[y]:
                x, y = y, x
            up[y] = x
            size[x] += size[y]
        return pa.table({"a": table.column("a"), "b": table.column("b"), "w": table.column("w"), "rank": table.column("rank"), "kind": pa.array(kind.astype(np.int32)), "end": pa.array(end, pa.int64())})

    return run


def _judged(tree: DataFrame, least: int, segment: int, tables: _Tables) -> DataFrame:
    """(a, b, w, rank, kind, end) of each edge of the tree, in order of reach."""
    placed = tables.keep(tree.repartitionByRange("w", "a", "b").sortWithinPartitions("w", "a", "b").withColumn("mid", F.monotonically_increasing_id()))
    now = _numbered(placed, "mid", "rank").withColumns({"seg": F.floor(F.col("rank") / segment), "u": F.col("a"), "v": F.col("b"), "su": F.lit(1).cast("long"), "sv": F.lit(1).cast("long")})
    span = 1
    while span * segment < placed.count():
        span *= 2
    while span > 1:
        # Ranges of ``span`` segments: what the lower half joins is one vertex for the upper half.
        half = span // 2
        now = tables.keep(now.withColumns({"range": F.floor(F.col("seg") / span), "upper": F.floor(F.col("seg") / half) % 2 == 1}))
        name = lambda c: F.col("range") * (1 << 40) + F.col(c)
        lower = now.where("not upper").select(name("u").alias("x"), name("v").alias("y"), "su", "sv")
        root = tables.components(lower, "x", "y")
        ends = lower.select(F.col("x").alias("node"), F.col("su").alias("s")).union(lower.select("y", "sv")).distinct()
        total = ends.join(root, "node").groupBy("root").agg(F.sum("s").alias("total"))
        root = tables.keep(root.join(total, "root").select("node", F.col("root").bitwiseAND((1 << 40) - 1).alias("root"), "total"))
        upper = now.where("upper")
        for c, s in (("u", "su"), ("v", "sv")):
            upper = upper.join(root, name(c) == root["node"], "left").withColumns({c: F.coalesce("root", c), s: F.coalesce("total", s)}).drop("node", "root", "total")
        now = now.where("not upper").unionByName(upper).drop("range", "upper")
        span = half
    return tables.keep(now.groupBy("seg").applyInArrow(_judge(least), f"{_EDGE}, rank long, kind int, end long"))


def _density(w: float) -> float:
    return 1.0 / max(w, LEAST_REACH)


class _Condensed:
    """The tree of clusters: leaves, and a cluster for each join, in order of time."""

    def __init__(self, joins: list):
        self.leaves = np.array(sorted({x for j in joins for x in (j["one"], j["two"])}), np.int64)
        n = len(self.leaves)
        self.parent = np.arange(n + len(joins))
        self.until = np.full(n + len(joins), np.iinfo(np.int64).max)
        self.reach = np.full(n + len(joins), np.inf)
        current = dict(zip(self.leaves.tolist(), range(n), strict=True))
        up = {x: x for x in current}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i, j in enumerate(sorted(joins, key=lambda j: j["rank"])):
            x, y = top(j["one"]), top(j["two"])
            for c in (current[x], current[y]):
                self.parent[c], self.until[c], self.reach[c] = n + i, j["rank"], j["w"]
            up[y] = x
            current[x] = n + i

    def place(self, leaf: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The cluster that a point came to, at the rank of its coming, in the branch of its leaf."""
        at = np.searchsorted(self.leaves, leaf)
        while True:
            over = self.until[at] < rank
            if not over.any():
                return at
            at = np.where(over, self.parent[at], at)

    def chosen(self, count: np.ndarray, density: np.ndarray) -> np.ndarray:
        """For each cluster the chosen one that it is in or is, or -1; ``count`` and ``density`` are of the points that came to each."""
        n = len(self.parent)
        inside, total = count.astype(float), density.astype(float)
        stable, best, choose = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        below = np.zeros(n)
        for c in range(n):  # parts come before what they are part of
            end = 0.0 if np.isinf(self.reach[c]) else _density(self.reach[c])
            stable[c] = total[c] - inside[c] * end
            # Clusters that end as they begin differ from zero by rounding alone.
            stable[c] *= stable[c] > 1e-12 * total[c]
            choose[c] = c < n - 1 and stable[c] > 0 and stable[c] >= below[c]
            best[c] = max(stable[c], below[c])
            p = self.parent[c]
            if p != c:
                inside[p] += inside[c]
                total[p] += inside[c] * end
                below[p] += best[c]
        out = np.full(n, -1)
        for c in range(n - 1, -1, -1):
            p = self.parent[c]
            out[c] = out[p] if p != c and out[p] >= 0 else c if choose[c] else -1
        return out


def density_clusters(rows: DataFrame, vec: str, least: int | None = None, neighbours: int | None = None, id: str | None = None, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with a column cluster_id, -1 for noise.

    ``least`` is the smallest cluster (a twentieth of the vectors, two at least, unless given), ``neighbours`` the k of
    core distances (``least``, ``NEIGHBOURS`` at most). Clusters are numbered by their smallest ``id`` (else in order of the rows).
    Vectors that are null, empty, not finite or of another length than most (ties: the shortest) are noise. Equal vectors, equal and null
    ids are points like others; equal reaches do not depend on the order of rows. Fewer than two clusters make none.
    """
    spark = rows.sparkSession
    tables = _Tables(spark)
    row = F.struct(*[rows[c] for c in rows.columns]).alias("row")
    points = tables.keep(rows.select(row, rows[vec].cast("array<double>").alias("vec"), F.monotonically_increasing_id().alias("mid")))
    points = _numbered(points, "mid", "node")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = points.where((F.size("vec") > 0) & finite)
    length = good.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    n = length["count"] if length else 0
    least = max(2, least or max(2, n // 20))
    plain = points.select("row.*", F.lit(-1).cast("long").alias("cluster_id"))
    if n < 2 * least:
        return plain
    good = good.where(F.size("vec") == length["size"]).select("node", "vec")
    k = min(neighbours or min(least, NEIGHBOURS), n)

    if n <= block:
        tree = tables.keep(good.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(_one_tree(k), _EDGE))
    else:
        distinct = tables.keep(good.groupBy("vec").agg(F.min("node").alias("node"), F.count("*").alias("times")))
        tree, cores = _tree(distinct, distinct.count(), k, block, tables)
        tree = tables.keep(_with_copies(tree, cores, distinct, good))
    judged = _judged(tree, least, segment, tables)

    leaf = tables.components(judged.where(F.col("kind") < JOINED), "a", "b")
    group = tables.components(judged.where(F.col("kind") == SMALL), "a", "b")
    joins = judged.where(F.col("kind") == JOINED).select("a", "b", "w", "rank")
    for end, name in (("a", "one"), ("b", "two")):
        joins = joins.join(leaf.select(F.col("node").alias(end), F.col("root").alias(name)), end)
    tree_of = _Condensed(joins.select("one", "two", "w", "rank").collect())
    if not len(tree_of.leaves):
        return plain

    comes = judged.where(F.col("kind").isin(TAKEN, BORN)).select(F.explode(F.when(F.col("kind") == TAKEN, F.array("end")).otherwise(F.array("a", "b"))).alias("node"), "w", "rank")
    comes = comes.join(group, "node", "left").select(F.coalesce("root", "node").alias("group"), "w", "rank")
    of = good.select("node").join(group, "node", "left").select("node", F.coalesce("root", "node").alias("group"))
    came = of.join(comes, "group").join(leaf, "node").select("node", F.col("root").alias("leaf"), "w", "rank")
    shared = spark.sparkContext.broadcast(tree_of)

    def placed(it):
        for batch in it:
            at = shared.value.place(batch.column("leaf").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("w"), pa.array(at)], names=["node", "w", "cluster"])

    at = tables.keep(came.mapInArrow(placed, "node long, w double, cluster long"))
    gathered = at.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(1 / F.greatest("w", F.lit(LEAST_REACH))).alias("density")).collect()
    count, density = np.zeros(len(tree_of.parent)), np.zeros(len(tree_of.parent))
    for r in gathered:
        count[r["cluster"]], density[r["cluster"]] = r["n"], r["density"]
    chosen = [(i, int(c)) for i, c in enumerate(tree_of.chosen(count, density)) if c >= 0]
    names = spark.createDataFrame(chosen, "cluster long, chosen long")
    mine = at.join(F.broadcast(names), "cluster").select("node", "chosen")
    labelled = tables.keep(points.join(mine, "node", "left").select("row", "node", "chosen"))
    first = F.col(f"row.`{id}`") if id else F.col("node")
    order = labelled.where("chosen is not null").groupBy("chosen").agg(F.min(first).alias("first"), F.min("node").alias("node")).collect()
    order.sort(key=lambda r: (True, r["node"]) if r["first"] is None else (False, r["first"], r["node"]))
    number = spark.createDataFrame([(r["chosen"], i) for i, r in enumerate(order)], "chosen long, cluster_id long")
    return labelled.join(F.broadcast(number), "chosen", "left").select("row.*", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"))

