"""Training of a two-level codebook: ``k`` macro codes, and for each of them ``m`` micro codes of what it leaves.

Seeds come from k-means|| (a few passes that draw rows in proportion to their squared distance from what was drawn before; the few
hundred drawn ones, weighted by the rows nearest to them, are reduced to ``k`` on the driver). A step assigns the rows of a batch,
adds sizes and sums per code (one row per macro code and task, merged in two levels), and moves the codes by exponential averages;
codes with too small a share restart at drawn rows. Each step's book is stored, so a killed training goes on where it stopped.

Draws follow from hashes of id, vector, seed and step, so a repeated task or run draws the same; sums of doubles differ by their order only.
The driver holds the book, (k + k * m) vectors, and as many drawn rows at most; its size is a parameter and does not grow with the rows.

Cases: rows whose vector is null, has another length than most or a component that is not finite teach nothing and get null codes; null and
repeated ids and repeated rows count like others; ties go to the smaller code; with fewer distinct vectors than ``k`` there are fewer macro codes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.sources.tables import read_or_empty

#: First-level groups of a macro code's partial sums, and the greatest number of codes of a book.
SPREAD, MOST = 64, 65536
_PARTIAL = "macro int, n array<long>, s array<double>, e array<double>"


@dataclass
class Book:
    """Codes with their running sizes and sums; micro arrays are by macro code."""

    macro: np.ndarray
    macro_size: np.ndarray
    macro_sum: np.ndarray
    micro: np.ndarray
    micro_size: np.ndarray
    micro_sum: np.ndarray
    #: Rows, squared distance to the macro codes and to macro plus micro codes that the last step found before it moved them.
    found: np.ndarray

    @classmethod
    def of(cls, macro: np.ndarray, macro_size: np.ndarray, micro: np.ndarray, micro_size: np.ndarray) -> Book:
        return cls(macro, macro_size, macro * macro_size[:, None], micro, micro_size, micro * micro_size[..., None], np.zeros(3))


def _nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each row, and the squared distance."""
    at = ((codes * codes).sum(1) - 2 * (x @ codes.T)).argmin(1)
    return at, ((x - codes[at]) ** 2).sum(1)


def assigned(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(macro, micro, squared distance to the macro code, to both together)."""
    macro, far = _nearest(x, book.macro)
    micro, left = np.zeros(len(x), np.int64), np.zeros(len(x))
    for j in np.unique(macro):
        own = np.flatnonzero(macro == j)
        micro[own], left[own] = _nearest(x[own] - book.macro[j], book.micro[j])
    return macro, micro, far, left


def _fitting(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of finite vectors of length ``d``, and them."""
    at = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("vec").cast("array<double>").alias("vec"))


def length_of(rows: DataFrame) -> int | None:
    """The most frequent length of a vector (ties: the smaller), None without vectors."""
    first = rows.where("vec is not null").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first and first["d"]


def _hash(seed: int, turn: int):
    return F.xxhash64("id", "vec", F.lit(seed), F.lit(turn))


def _clean(rows: DataFrame, d: int) -> DataFrame:
    return _rows(rows).where((F.size("vec") == d) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def seeds(rows: DataFrame, k: int, d: int, seed: int = 0, rounds: int = 5, over: float = 2.0) -> np.ndarray:
    """At most k starting codes by k-means||; a round draws ``over`` * k rows on average, equal vectors once."""
    rows = _clean(rows, d)
    drawn = np.array([r["vec"] for r in rows.orderBy(_hash(seed, -1), "vec").limit(1).collect()], float).reshape(-1, d)
    if not len(drawn):
        return drawn

    def far(codes: np.ndarray) -> Callable:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                _, x = _fitting(batch.column("vec"), d)
                yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("u"), pa.array(_nearest(x, codes)[1])], names=["vec", "u", "far"])

        return run

    for turn in range(rounds):
        u = F.shiftrightunsigned(_hash(seed, turn), 11) / F.lit(2.0**53)
        away = rows.select("vec", u.alias("u")).mapInArrow(far(drawn), "vec array<double>, u double, far double")
        cost = away.agg(F.sum("far")).first()[0]
        if not cost:
            break
        new = away.where(F.col("u") * cost < F.lit(over * k) * F.col("far")).select("vec").distinct().collect()
        drawn = np.unique(np.concatenate([drawn, np.array([r["vec"] for r in new], float).reshape(-1, d)]), axis=0)

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(drawn), np.int64)
        for batch in it:
            total += np.bincount(_nearest(_fitting(batch.column("vec"), d)[1], drawn)[0], minlength=len(drawn))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(drawn))), pa.array(total)], names=["at", "n"])

    weight = np.zeros(len(drawn))
    for at, n in rows.select("vec").mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        weight[at] = n
    return reduced(drawn, weight, k, seed)


def reduced(points: np.ndarray, weight: np.ndarray, k: int, seed: int, turns: int = 20) -> np.ndarray:
    """k means of a few weighted points: drawn in proportion to weighted squared distance, then moved to their means."""
    draw = np.random.default_rng(seed)
    codes, far = np.zeros((0, points.shape[1])), np.ones(len(points))
    while len(codes) < k and (weight * far).sum() > 0:
        share = weight * far
        codes = np.concatenate([codes, points[[draw.choice(len(points), p=share / share.sum())]]])
        far = _nearest(points, codes)[1]
    for _ in range(turns):
        at = _nearest(points, codes)[0]
        size = np.bincount(at, weight, len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, at, points * weight[:, None])
        codes = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], codes)
    return codes[np.lexsort(codes.T[::-1])]


def partials(book: Book) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and macro code: rows by micro code; the sum of vectors, then of residuals by micro code; both distances."""
    k, m, d = book.micro.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, whole, rest, e = np.zeros((k, m), np.int64), np.zeros((k, d)), np.zeros((k, m, d)), np.zeros((k, 2))
        for batch in it:
            _, x = _fitting(batch.column("vec"), d)
            macro, micro, far, left = assigned(x, book)
            np.add.at(n, (macro, micro), 1)
            np.add.at(whole, macro, x)
            np.add.at(rest, (macro, micro), x - book.macro[macro])
            np.add.at(e, macro, np.stack([far, left], axis=1))
        for j in np.flatnonzero(n.sum(1)):
            s = np.concatenate([whole[j], rest[j].ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), *(pa.array([v.tolist()]) for v in (n[j], s, e[j]))], names=["macro", "n", "s", "e"])

    return run


def _total(names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        out = {c: table.column(c).slice(0, 1) for c in names}
        flat = lambda c: np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in table.column(c).chunks]).reshape(table.num_rows, -1)
        return pa.table(out | {c: [flat(c).sum(0).tolist()] for c in ("n", "s", "e")}, schema=table.select([*names, "n", "s", "e"]).schema)

    return run


def moved(book: Book, n: np.ndarray, whole: np.ndarray, rest: np.ndarray, decay: float, eps: float) -> Book:
    """The book after sizes and sums moved towards those of a batch; macro sizes are smoothed so that none is 0, micro sizes by ``eps`` alone."""
    size = decay * book.macro_size + (1 - decay) * n.sum(1)
    total = decay * book.macro_sum + (1 - decay) * whole
    smooth = (size + eps) / (size.sum() + len(size) * eps) * size.sum()
    micro_size = decay * book.micro_size + (1 - decay) * n
    micro_sum = decay * book.micro_sum + (1 - decay) * rest
    # Codes without any weight stay where they are.
    macro = np.where(size[:, None] > 0, total / np.maximum(smooth, 1e-300)[:, None], book.macro)
    micro = np.where(micro_size[..., None] > 0, micro_sum / np.maximum(micro_size + eps, 1e-300)[..., None], book.micro)
    return Book(macro, size, total, micro, micro_size, micro_sum, book.found)


def dead(book: Book, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Macro codes with less than a share ``least`` of the rows, and (macro, micro) with less than ``least`` / k of them."""
    macro = book.macro_size < least * max(book.macro_size.sum(), 1.0)
    micro = book.micro_size < least / len(book.macro) * max(book.micro_size.sum(), 1.0)
    return np.flatnonzero(macro), np.argwhere(micro)


def restarted(book: Book, drawn: np.ndarray, before: np.ndarray, least: float) -> Book:
    """Dead codes set to drawn vectors, micro ones to what the codes ``before`` leave of them, with size 1; those for which none is left stay."""
    macro, micro = dead(book, least)
    macro = macro[: len(drawn)]
    first = drawn[: len(macro)]
    book.macro[macro], book.macro_sum[macro], book.macro_size[macro] = first, first, 1.0
    others = drawn[len(macro) :]
    micro = micro[: len(others)]
    if len(micro):
        others = others[: len(micro)]
        left = others - before[_nearest(others, before)[0]]
        at = (micro[:, 0], micro[:, 1])
        book.micro[at], book.micro_sum[at], book.micro_size[at] = left, left, 1.0
    return book


def step(book: Book, rows: DataFrame, decay: float = 0.99, eps: float = 1e-5, least: float = 0.0, seed: int = 0, turn: int = 0) -> Book:
    """The book after one batch of rows (id, vec)."""
    k, m, d = book.micro.shape
    rows = _clean(rows, d)
    part = rows.select("vec").mapInArrow(partials(book), _PARTIAL).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    once = part.groupBy("macro", "part").applyInArrow(_total(["macro", "part"]), "macro int, part int, n array<long>, s array<double>, e array<double>")
    got = once.drop("part").groupBy("macro").applyInArrow(_total(["macro"]), _PARTIAL).collect()
    n, whole, rest, e = np.zeros((k, m), np.int64), np.zeros((k, d)), np.zeros((k, m, d)), np.zeros(2)
    for r in got:
        s = np.array(r["s"])
        n[r["macro"]], whole[r["macro"]], rest[r["macro"]] = r["n"], s[:d], s[d:].reshape(m, d)
        e += r["e"]
    if not n.sum():
        return book
    new = moved(book, n, whole, rest, decay, eps)
    new.found = np.array([n.sum(), *e])
    gone = sum(map(len, dead(new, least)))
    if gone:
        drawn = rows.orderBy(_hash(seed, turn), "vec").limit(gone).collect()
        new = restarted(new, np.array([r["vec"] for r in drawn], float).reshape(-1, d), book.macro, least)
    return new


def start(rows: DataFrame, k: int, m: int, seed: int = 0) -> Book | None:
    """A book from k-means|| seeds; a macro code's micro codes start at the residuals of ``m`` of its rows, the smallest by hash; None without vectors."""
    if k < 1 or m < 1 or k * m > MOST:
        raise ValueError(f"a book has 1 to {MOST} codes")
    d = length_of(rows)
    macro = seeds(rows, k, d, seed) if d else None
    if macro is None or not len(macro):
        return None

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task passes on the m vectors of each macro code that come first; equal ones have equal hashes.
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in it:
            _, x = _fitting(batch.column("vec"), d)
            h, macro_of = batch.column("h").to_numpy(), _nearest(x, macro)[0]
            for j in np.unique(macro_of):
                own = macro_of == j
                old = best.get(j, (np.zeros(0, np.int64), np.zeros((0, d))))
                names, vectors = np.concatenate([old[0], h[own]]), np.concatenate([old[1], x[own]])
                names, at = np.unique(names, return_index=True)
                best[j] = names[:m], vectors[at[:m]]
        for j, (names, vectors) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), j, np.int32)), pa.array(names), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["macro", "h", "vec"])

    found = _clean(rows, d).select("vec", F.xxhash64("vec", F.lit(seed)).alias("h")).mapInArrow(near, "macro int, h long, vec array<double>")
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    for by in (["macro", "part"], ["macro"]):
        order = Window.partitionBy(*by).orderBy("h", "vec")
        found = found.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= m).dropDuplicates([*by, "n"])
    found = found.groupBy("macro").agg(F.sort_array(F.collect_list(F.struct("h", "vec"))).alias("first"))
    micro = np.zeros((len(macro), m, d))
    for r in found.collect():
        left = np.array([f["vec"] for f in r["first"]], float) - macro[r["macro"]]
        micro[r["macro"], : len(left)] = left
    return Book.of(macro, np.ones(len(macro)), micro, np.ones(micro.shape[:2]))


_SHAPES = "turn int, k int, m int, d int, " + ", ".join(f"{f.name} array<double>" for f in fields(Book))


def stored(spark: SparkSession, root: str) -> tuple[int, Book] | None:
    """The last stored step and its book."""
    states = read_or_empty(spark, f"{root}/states", _SHAPES)
    last = states.agg(F.max("turn")).first()[0]
    if last is None:
        return None
    r = states.where(F.col("turn") == last).first()
    k, m, d = r["k"], r["m"], r["d"]
    shape = {"macro": (k, d), "macro_size": (k,), "macro_sum": (k, d), "micro": (k, m, d), "micro_size": (k, m), "micro_sum": (k, m, d), "found": (3,)}
    return last, Book(**{name: np.array(r[name]).reshape(s) for name, s in shape.items()})


def _store(spark: SparkSession, root: str, turn: int, book: Book) -> None:
    k, m, d = book.micro.shape
    row = (turn, k, m, d, *(getattr(book, f.name).ravel().tolist() for f in fields(Book)))
    # One file, which appears as a whole.
    spark.createDataFrame([row], _SHAPES).coalesce(1).write.mode("overwrite").parquet(f"{root}/states/state={turn}")


def train(rows: DataFrame, root: str, k: int = 64, m: int = 64, steps: int = 10, batches: int = 1, decay: float = 0.99, eps: float = 1e-5, least: float = 0.0, seed: int = 0) -> Book | None:
    """The book after ``steps`` steps, each on one of ``batches`` parts of the rows by hash; steps that ``root`` has are not done again."""
    spark = rows.sparkSession
    known = stored(spark, root)
    if known is None:
        book = start(rows, k, m, seed)
        if book is None:
            return None
        _store(spark, root, 0, book)
        known = (0, book)
    done, book = known
    for turn in range(done + 1, steps + 1):
        batch = rows if batches == 1 else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)) == turn % batches)
        book = step(book, batch, decay, eps, least, seed, turn)
        _store(spark, root, turn, book)
    return book


def coded(rows: DataFrame, book: Book) -> DataFrame:
    """(id, macro, micro, error) of every row; nulls where a vector does not fit."""
    d = book.macro.shape[1]
    kind = rows.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, x = _fitting(batch.column("vec"), d)
            macro, micro, _, left = assigned(x, book)
            none = np.ones(batch.num_rows, bool)
            none[at] = False

            def spread(values, dtype, at=at, none=none):
                out = np.zeros(len(none), dtype)
                out[at] = values
                return pa.array(out, mask=none)

            yield pa.RecordBatch.from_arrays([batch.column("id"), spread(macro, np.int32), spread(micro, np.int32), spread(left, float)], names=["id", "macro", "micro", "error"])

    return _rows(rows).mapInArrow(run, f"id {kind}, macro int, micro int, error double")
