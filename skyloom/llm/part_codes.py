"""Vector code compression: each vector becomes a few small numbers, the nearest codebook entry of each of its parts.

Components are integers (floor of ``SCALE`` times the value), so sums and distances are exact and do not depend on the
order of rows, tasks or merges. Tasks hold vectors as columnar blocks (component by row); the distances of a part grow
one dimension at a time, and each round's sums and counts per entry are one int64 tensor a task, merged by ``treeAggregate``.
A tensor has parts * entries * (dimensions of a part + 1) numbers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.work import stored, tidy

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows of a block: 64 entries of int64 distances to them are 1 MB.
BLOCK = 2048
#: Scaled components below this size keep sums of 2**33 rows and distances over parts of 64 within int64.
LARGEST = 1 << 28


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & whole, F.lit(False))


def _rows(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows can be coded, their integer components: width x rows). Rows of another length or with huge components cannot."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    right = np.flatnonzero(np.diff(offsets) == width)
    scaled = values[offsets[right][:, None] + np.arange(width)] * scale
    small = (np.abs(scaled) < LARGEST).all(axis=1)
    return right[small], np.ascontiguousarray(np.floor(scaled[small]).T).astype(np.int64)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each parts x rows: the nearest entry of each part, ties to the lower index.

    ``block``: components x rows; ``books``: parts x entries x dimensions of a part.
    """
    parts, entries, width = books.shape
    codes, errors = np.zeros((parts, block.shape[1]), np.int64), np.zeros((parts, block.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((entries, block.shape[1]), np.int64)
        for d in range(width):
            apart = books[p, :, d, None] - block[p * width + d]
            far += apart * apart
        codes[p] = far.argmin(axis=0)
        errors[p] = far.min(axis=0)
    return codes, errors


def _blocks(width: int, scale: int):
    """Columnar blocks of the vectors that can be coded."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, BLOCK):
                _, block = _rows(batch.column(0).slice(at, BLOCK), width, scale)
                if block.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

    return run


def _gather(books: np.ndarray):
    """Adds a block to the tensor of sums (all but the last column) and counts (the last)."""

    def add(total: np.ndarray, row) -> np.ndarray:
        parts, entries, width = books.shape
        block = np.frombuffer(row.block, np.int64).reshape(parts * width, -1)
        codes, _ = nearest(block, books)
        for p in range(parts):
            for d in range(width):
                np.add.at(total[p, :, d], codes[p], block[p * width + d])
            np.add.at(total[p, :, width], codes[p], 1)
        return total

    return add


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def train(vectors: DataFrame, vec: str = "embedding", id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, depth: int = 2) -> np.ndarray | None:
    """Codebooks (parts x entries x dimensions, integers) of finite ``vectors``; None if none can be coded.

    They begin as the parts of the ``entries`` smallest ids (rows with equal ids in the order of their vectors, fewer entries
    if there are fewer rows, null ids never); each round assigns all parts and moves each used entry to the floor of their mean.
    The common length is that of most vectors (ties: the least), among the lengths that ``parts`` divides.
    """
    length = vectors.groupBy(F.size(vec).alias("size")).count().where((F.col("size") > 0) & (F.col("size") % parts == 0)).orderBy(F.desc("count"), "size").first()
    if length is None:
        return None
    size = length["size"]
    fits = (F.size(vec) == size) & F.forall(vec, lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    first = vectors.where(fits & F.col(id).isNotNull()).select(id, F.col(vec).cast("array<double>").alias("vec")).orderBy(id, "vec").limit(entries).collect()
    if not first:
        return None
    start = np.floor(np.array([r["vec"] for r in first]) * scale).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    blocks = vectors.select(F.col(vec).cast("array<double>").alias("vec")).mapInArrow(tidy(_blocks(size, scale)), "block binary")
    for _ in range(rounds):
        zero = np.zeros((parts, books.shape[1], books.shape[2] + 1), np.int64)
        total = blocks.rdd.treeAggregate(zero, _gather(books), _merge, depth)
        used = total[:, :, -1:] > 0
        books = np.where(used, total[:, :, :-1] // np.maximum(total[:, :, -1:], 1), books)
    return books


def _codes(books: np.ndarray | None, scale: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_rows
            text, error = np.full(n, None, object), np.full(n, None, object)
            for at in range(0, n if books is not None else 0, BLOCK):
                which, block = _rows(batch.column(1).slice(at, BLOCK), books.shape[0] * books.shape[2], scale)
                codes, far = nearest(block, books)
                text[at + which] = [bytes(c).hex() for c in codes.T.astype(np.uint8)]
                error[at + which] = far.sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["rest", "code", "error"])

    return run


def encode(vectors: DataFrame, books: np.ndarray | None, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(rest: struct of the other columns, code, error) of finite ``vectors``: two hex digits a part, and the squared distances summed.

    Both are null where the length is not the codebooks' or a component is too large (see ``LARGEST``).
    """
    others = [vectors[c] for c in vectors.columns if c != vec] or [F.lit(0).alias("none")]
    base = vectors.select(F.struct(*others).alias("rest"), vectors[vec].cast("array<double>").alias("vec"))
    out = T.StructType([base.schema["rest"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return base.mapInArrow(tidy(_codes(books, scale)), out)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", scale: int = SCALE) -> DataFrame:
    """``codes`` with a column ``approximate``: the vector that the code stands for (null for a null code)."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in part]) for part in books])
    pick = lambda p: F.get(F.get(table, F.lit(p)), F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int"))
    return codes.withColumn("approximate", F.when(F.col(code).isNotNull(), F.flatten(F.array(*[pick(p) for p in range(len(books))]))))


def books_sha256(books: np.ndarray | None) -> str:
    """Digest of all components in order: by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all vectors of ``embeddings``.

    Rows whose vector is null or not finite are left out. Vectors of another length than most, or with components of a
    million and more, stay with a null code and error. Repeated rows and equal ids are rows of their own, null labels are
    one label, further columns are not read, and an empty table gives no rows.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    vectors = table.where(finite(F.col("embedding")))
    books = train(vectors)
    coded = stored(encode(vectors, books).select("rest.vec_id", "rest.label", "code", "error"), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
