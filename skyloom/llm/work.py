"""Shared storage, partition counts and connected components for the corpus operators."""

from __future__ import annotations

import ctypes
import struct
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, one of our own, but on one machine only: executors of a cluster do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _lock = [], threading.Lock()


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go at its end; the session's own setting comes back after the last of several writes."""
    with _lock:
        _writing.append(_writing[0] if _writing else spark.conf.get(_CLEAN))
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            before = _writing.pop()
            if not _writing:
                spark.conf.set(_CLEAN, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    # The table replaces all that led to it.
    with _shuffle_files_go(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._skyloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; the frame must not be read again."""
    path = getattr(df, "_skyloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """The number of reduce partitions, which the session sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exchange(df: DataFrame, column: str = "bucket") -> DataFrame:
    """Send rows to the partition that an integer column in 0..partitions-1 names."""
    return df.repartitionById(partitions(df.sparkSession), F.col(column).cast("int"))


@cache
def _libc():
    return ctypes.CDLL(None)


def tidy(run):
    """``run`` for ``mapInArrow``; at its end the worker, which later tasks use again, gives its free memory back."""

    @wraps(run)
    def tidied(it):
        yield from run(it)
        pa.default_memory_pool().release_unused()
        if hasattr(_libc(), "malloc_trim"):
            _libc().malloc_trim(0)

    return tidied


_ZSTD = zstandard.ZstdCompressor(level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, so that a block crosses the exchange as a single row."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sQ", a.dtype.str.encode(), a.nbytes) for a in arrays)
    return _ZSTD.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n, at, out = raw[0], 1 + 11 * raw[0], []
    for i in range(n):
        kind, size = struct.unpack_from("<3sQ", raw, 1 + 11 * i)
        out.append(np.frombuffer(raw, np.dtype(kind.decode()), size // np.dtype(kind.decode()).itemsize, at))
        at += size
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs.

    Returns (node, root): the smallest node that each linked node reaches.
    Alternates large-star and small-star steps, each a pre-aggregated minimum
    and a join, until no edge changes. A node with very many edges is an
    aggregated minimum and one side of a join that AQE can split. Nulls and
    self-links are ignored; an empty list gives an empty result.
    """
    spark = edges.sparkSession
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and v is not null").distinct(), "edges"
    )
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before is not None and tuple(sign) == before or not sign["n"]:
            break
        before = tuple(sign)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt = stored(small.distinct(), "edges")
        discard(large)
        discard(now)
        now = nxt
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
