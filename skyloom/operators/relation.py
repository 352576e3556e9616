"""Neighbour searches, edges, co-occurrence and codebooks over vectors.

Vectors are arrays; products run in the JVM in double. The side that is searched
(a codebook, a mesh, a bank) is bounded by its caller and compared block by block,
so no task sees more than one block against its own rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.angles import dot, norm

#: Rows of a searched side that are shipped to the tasks at once; beyond, they are joined by blocks.
BLOCK_ROWS = 65536
#: Rows of either side of one matrix product.
TILE = 2048
#: Pairs of blocks for each core, so that small tables too keep all cores busy.
PAIRS_PER_CORE = 4


def normalised(df: DataFrame, vec: str = "vec") -> DataFrame:
    # The length is bound once, as an element of an array: inside the inner function it would be computed for every component.
    scaled = F.transform(F.array(norm(F.col(vec))), lambda n: F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n)))
    return df.withColumn(vec, scaled[0])


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    parts = vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors]
    flat = np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts])
    return flat.reshape(len(vectors), -1)


def k_nearest(queries: DataFrame, points: DataFrame, k: int, largest: bool = True, drop_self: bool = False) -> DataFrame:
    """(src, slot, dst, score): the k points of greatest (or least) dot product with each query, ties by id.

    Both frames are (id, vec); ids of points are distinct, rows without a vector have no part, nor have pairs whose product is no number or -Infinity. Both are cut into blocks of ``BLOCK_ROWS`` at most,
    and so many that all cores have some; a task holds one block of each, keeps k points for each query by products of ``TILE`` rows a side, and
    the blocks' bests meet by query: rows grow with queries times blocks, never with pairs.
    """
    point = points.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    asked = queries.select(F.col("id").cast("long").alias("src"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    n_points, n_asked = points.count(), queries.count()
    cut = math.ceil(math.sqrt(PAIRS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism))
    n_blocks, n_shards = (max(1, -(-n // BLOCK_ROWS), min(cut, -(-n // TILE))) for n in (n_points, n_asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    point = point.withColumn("block", part("id", n_blocks)).withColumn("shard", every(n_shards))
    asked = asked.withColumn("shard", part("src", n_shards)).withColumn("block", every(n_blocks))
    paired = asked.groupBy("block", "shard").cogroup(point.groupBy("block", "shard"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("id")
        ids, x = right.column("id").to_numpy(), _matrix(right.column("vec"))
        out = []
        for batch in left.to_batches(TILE):
            names, q = batch.column("src").to_numpy(), _matrix(batch.column("vec"))
            row, dst, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            least = np.full(len(names), -np.inf)
            for at in range(0, len(ids), TILE):
                own = ids[at : at + TILE]
                s = q @ x[at : at + TILE].T
                if not largest:
                    np.negative(s, out=s)
                # Vectors that are not finite have no place in an order.
                s[np.isnan(s)] = -np.inf
                if drop_self:
                    place = np.minimum(np.searchsorted(own, names), len(own) - 1)
                    itself = np.flatnonzero(own[place] == names)
                    s[itself, place[itself]] = -np.inf
                # Ties with the k-th best stay until ids decide. Only the first tile is searched for it; later ones have few rows that reach the bar so far.
                bar = least
                if len(own) > k and np.isneginf(least).any():
                    bar = np.maximum(least, np.partition(s, len(own) - k, axis=1)[:, len(own) - k])
                reached = np.flatnonzero(s >= np.maximum(bar, -sys.float_info.max)[:, None])
                i, j = np.divmod(reached, len(own))
                row, dst, score = np.concatenate([row, i]), np.concatenate([dst, own[j]]), np.concatenate([score, s[i, j]])
                order = np.lexsort((dst, -score, row))
                row, dst, score = row[order], dst[order], score[order]
                first = np.searchsorted(row, np.arange(len(names)))
                kept = np.arange(len(row)) - first[row] < k
                row, dst, score = row[kept], dst[kept], score[kept]
                count = np.bincount(row, minlength=len(names))
                full = np.flatnonzero(count == k)
                least[full] = score[np.cumsum(count)[full] - 1]
            out.append(pa.table([names[row], dst, score if largest else -score], schema=schema))
        return pa.concat_tables(out)

    near = paired.applyInArrow(best, "src long, dst long, score double")
    order = F.desc("score") if largest else F.asc("score")
    ranked = near.withColumn("slot", F.row_number().over(Window.partitionBy("src").orderBy(order, "dst")))
    return ranked.where(F.col("slot") <= k).select("src", "slot", "dst", "score")


def nearest_code(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds code: the row of a bounded codebook (code, vec) of greatest cosine, ties to the smallest."""
    rows = sorted(codes.select("code", "vec").collect(), key=lambda r: r[0])
    names = np.array([r[0] for r in rows], np.int64)
    book = np.array([r[1] for r in rows], float)
    book /= np.maximum(np.sqrt((book * book).sum(1, keepdims=True)), 1e-12)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array(batch.column("vec").to_pylist(), float).reshape(batch.num_rows, -1)
            code = names[(x @ book.T).argmax(1)] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(code)], names=["id", "code"])

    return df.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, code long")


def two_level_code(df: DataFrame, macro: DataFrame, micro: DataFrame) -> DataFrame:
    """(id, macro, micro): the nearest macro code, then the nearest micro code of that macro to the residual.

    macro: (macro, vec); micro: (macro, micro, vec). Codebooks hold 64 x 64 codes at most, so they are broadcast.
    """
    distance = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    x = df.select("id", F.col("vec").cast("array<double>").alias("vec"))
    m = F.broadcast(macro.groupBy().agg(F.collect_list(F.struct("macro", F.col("vec").cast("array<double>").alias("vec"))).alias("book")))
    pick = lambda book, v, name: F.array_min(F.transform(book, lambda c: F.struct(distance(c["vec"], v).alias("d"), c[name].alias("c"), c["vec"].alias("v"))))
    first = x.crossJoin(m).withColumn("p", pick(F.col("book"), F.col("vec"), "macro"))
    first = first.select("id", F.col("p.c").alias("macro"), F.zip_with("vec", F.col("p.v"), lambda a, b: a - b).alias("rest"))
    s = F.broadcast(micro.groupBy("macro").agg(F.collect_list(F.struct("micro", F.col("vec").cast("array<double>").alias("vec"))).alias("book")))
    second = first.join(s, "macro").withColumn("p", pick(F.col("book"), F.col("rest"), "micro"))
    return second.select("id", "macro", F.col("p.c").alias("micro"))


def updated_codes(assigned: DataFrame, codes: DataFrame, decay: float = 0.99, eps: float = 1e-5) -> DataFrame:
    """(code, size, vec): exponential moving averages of code sizes and sums, sizes smoothed so that none is 0."""
    seen = assigned.groupBy("code", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    flat = codes.select("code", "size", F.posexplode("vec").alias("i", "v"))
    new = flat.join(seen, ["code", "i"], "left").withColumn("size", decay * F.col("size") + (1 - decay) * F.coalesce("n", F.lit(0)))
    new = new.withColumn("s", F.col("v") * (F.col("size") - (1 - decay) * F.coalesce("n", F.lit(0))) + (1 - decay) * F.coalesce("s", F.lit(0.0)))
    grouped = new.groupBy("code").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))
    everything = Window.partitionBy()
    total, k = F.sum("size").over(everything), F.count("*").over(everything)
    smooth = (F.col("size") + eps) / (total + k * eps) * total
    return grouped.withColumn("smooth", smooth).select("code", "size", F.transform("s", lambda x: x["s"] / F.col("smooth")).alias("vec"))


def reseeded_codes(codes: DataFrame, bank: DataFrame, least: float = 0.01, seed: int = 0) -> DataFrame:
    """``codes`` (code, size, vec) with those that hold less than a share ``least`` of all restarted at vectors of ``bank`` (id, vec).

    A restarted code has size 1. The vectors are drawn by hash of the id, each at most once, so a
    repeated run draws the same; if the bank holds fewer, the other codes stay. Codebooks are bounded.
    """
    share = F.col("size") / F.greatest(F.sum("size").over(Window.partitionBy()), F.lit(1.0))
    marked = codes.withColumn("_dead", share < least)
    dead = marked.where("_dead").withColumn("_n", F.row_number().over(Window.orderBy("code"))).select("code", "_n")
    drawn = bank.where("vec is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(codes.count())
    drawn = drawn.withColumn("_n", F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed)), "id"))).select("_n", F.col("vec").cast("array<double>").alias("_vec"))
    new = dead.join(drawn, "_n").select("code", "_vec")
    joined = codes.join(new, "code", "left")
    size = F.when(F.col("_vec").isNull(), F.col("size")).otherwise(1.0)
    return joined.select("code", size.alias("size"), F.coalesce("_vec", F.col("vec").cast("array<double>")).alias("vec"))


def isolation(codes: DataFrame) -> DataFrame:
    """(id, mean_cosine, percentile): mean cosine to all other codes; the most isolated is near 100.

    The mean needs only the sum of all unit vectors, so no pairs are formed.
    """
    unit = normalised(codes.select("id", "vec"))
    parts = unit.select("id", F.posexplode("vec").alias("i", "x"))
    sums = parts.groupBy("i").agg(F.sum("x").alias("s"))
    k = codes.count()
    mean = parts.join(F.broadcast(sums), "i").groupBy("id").agg(((F.sum(F.col("x") * F.col("s")) - F.sum(F.col("x") * F.col("x"))) / max(k - 1, 1)).alias("mean_cosine"))
    rank = F.row_number().over(Window.orderBy("mean_cosine", "id"))
    return mean.withColumn("percentile", 100.0 - 100.0 * rank / k)


def dim_variance(codes: DataFrame) -> DataFrame:
    """(id, magnitude, dim_variance) of each vector."""
    flat = codes.select("id", F.explode("vec").alias("x")).withColumn("x", F.col("x").cast("double"))
    return flat.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("magnitude"), F.var_pop("x").alias("dim_variance"))


def cooccurrence(tokens: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, n): how often token b stands at a neighbour of token a. tokens: (by..., node, token); edges: (src, dst)."""
    here = tokens.select(*by, F.col("node").alias("src"), F.col("token").alias("a"))
    there = tokens.select(*by, F.col("node").alias("dst"), F.col("token").alias("b"))
    return here.join(edges.select("src", "dst"), "src").join(there, [*by, "dst"]).groupBy("a", "b").agg(F.count("*").alias("n"))


def conditional(counts: DataFrame, k: int) -> DataFrame:
    """The k most probable other tokens beside each token."""
    other = counts.where("a <> b").withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("a")))
    order = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return other.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within(df: DataFrame, points: DataFrame, most: float, distance) -> DataFrame:
    """Each row with the nearest of a few points strictly within a distance, null if none is. points: (point, lat, lon), broadcast.

    distance(row, point) makes the column from the two frames' structs.
    """
    gathered = F.broadcast(points.groupBy().agg(F.collect_list(F.struct(*points.columns)).alias("_p")))
    far = df.crossJoin(gathered).withColumn("_d", F.array_min(F.transform("_p", lambda p: F.struct(distance(p).alias("d"), p["point"].alias("point")))))
    return far.withColumns({"point": F.when(F.col("_d.d") < most, F.col("_d.point")), "distance": F.when(F.col("_d.d") < most, F.col("_d.d"))}).drop("_p", "_d")


def highest_within(asked: DataFrame, rows: DataFrame, reach: float) -> DataFrame:
    """(at, value, id): for each distinct ``at`` of asked (at) the greatest value of rows (value, id) in at - reach to at + reach, with its least id.

    Equal values are one row first. Then each block of values, as wide as the whole band, is a window in which the last value
    before at + reach is taken; a block's greatest value goes along into the next two, where a band that ends in them may begin.
    Rows grow with the two tables, never with the pairs that a band holds.
    """
    block = lambda c: F.floor(c / (2.0 * reach))
    best = rows.where("value is not null").groupBy("value").agg(F.min("id").alias("id")).withColumn("block", block(F.col("value")))
    # Blocks beyond the range of a long are one block, whose neighbours no band reaches.
    last = best.groupBy("block").agg(F.max(F.struct("value", "id")).alias("top")).where(F.abs("block") < 1 << 62)
    carried = last.select("top.value", "top.id", F.explode(F.array(F.col("block") + 1, F.col("block") + 2)).alias("block"))
    found = best.unionByName(carried).select("block", F.col("value").alias("end"), F.lit(0).alias("kind"), F.struct("value", "id").alias("found"), F.lit(None).cast("double").alias("at"))
    end = F.col("at") + reach
    wanted = asked.where("at is not null").select("at").distinct().select(block(end).alias("block"), end.alias("end"), F.lit(1).alias("kind"), F.lit(None).cast(found.schema["found"].dataType).alias("found"), "at")
    along = Window.partitionBy("block").orderBy("end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = found.unionByName(wanted).withColumn("found", F.last("found", ignorenulls=True).over(along)).where("kind = 1")
    return met.select("at", "found.value", "found.id").where(F.col("value") >= F.col("at") - reach)


def anchored(df: DataFrame, anchor: DataFrame) -> DataFrame:
    """(id, norm, cosine) of each vector against the one anchor."""
    one = F.broadcast(anchor.select(F.col("vec").alias("_a")).limit(1))
    x, a = F.col("vec"), F.col("_a")
    scale = norm(x) * norm(a)
    return df.crossJoin(one).select("id", norm(x).alias("norm"), F.when(scale > 0, dot(x, a) / F.nullif(scale, F.lit(0.0))).alias("cosine"))


def spine(df: DataFrame, profiles: list[DataFrame], key: str) -> DataFrame:
    """Left joins of profiles on a key; absent values are null."""
    for p in profiles:
        df = df.join(p, key, "left")
    return df
