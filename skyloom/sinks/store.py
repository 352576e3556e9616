"""The tiered store: three tiers of partitioned Parquet with provenance, and the wire frame of a viewport."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.calendar import FRAMES_PER_DAY, FRAMES_PER_HOUR, century_of
from skyloom.operators.rollup import daily, frame_bucket, hourly
from skyloom.operators.viewport import Viewport, centuries, route, viewport
from skyloom.session import PROJECTION_VERSION, check_projection
from skyloom.sinks import layout
from skyloom.sources.tables import read_or_empty

TIERS = ("tier1", "tier2", "tier3")
#: The magic number of a wire frame of this layout ("SKYL", little-endian), and its version.
MAGIC, VERSION = 0x4C594B53, 2
#: The block of rows that are written without a block's name.
UNNAMED = "unnamed"
#: Rows of a file, at most.
ROWS_PER_FILE = 4_000_000


class TieredStore:
    """Rows by frame and node (tier1), by hour (tier2) and by day (tier3) under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def present(self) -> set[str]:
        return {t for t in TIERS for fs, p in [self._fs(f"{self.root}/{t}")] if fs.exists(p)}

    def write(self, tier: str, df: DataFrame, block: str = UNNAMED) -> None:
        """Adds rows to a tier. A block replaces the block of that name in the centuries written and leaves all others, so blocks
        of a century add up and a repeated run changes nothing; rows without a block's name are a block of their own.

        Rows are dealt by range, so that no century is one task, in files of bounded length, pages of ``layout.PAGE`` rows
        and the order of ``layout``, whose manifest lies beside the tier. They are computed once, into a table that goes after the write.
        """
        with self._once(df) as rows:
            self._write(tier, rows, block)
        self.stamp()

    @contextmanager
    def _once(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` as a table of its own, as a write reads its rows several times; the table is deleted at the end."""
        path = f"{self.root}/passing/{uuid.uuid4().hex}"
        try:
            df.write.parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _write(self, tier: str, df: DataFrame, block: str) -> None:
        """``write`` of rows that cost no more than a scan."""
        out, parts = df.withColumn("century", century_of(F.col("jd"))).withColumn("block", F.lit(block)), ["century", "block"]
        if not layout.NEEDED <= set(out.columns):
            order = ["century", *[c for c in ("h3", "jd") if c in out.columns]]
            self._put(out.repartitionByRange(*order).sortWithinPartitions(*order), tier, parts)
            return
        seen = layout.measured(out, "century")
        self._put(layout.arranged(out, "century", seen), tier, parts)
        # Of the partitions just written alone; what a block replaces, its bricks replace.
        written = self.spark.read.parquet(f"{self.root}/{tier}").where(F.col("century").isin(seen["parts"]) & (F.col("block") == block))
        self._put(layout.bricks(written, parts).sortWithinPartitions("century", F.desc("rarity_min")), f"manifest/{tier}", parts)

    def _put(self, df: DataFrame, name: str, parts: list[str]) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
        writer.option("parquet.page.row.count.limit", layout.PAGE).partitionBy(*parts).parquet(f"{self.root}/{name}")

    def stamp(self) -> None:
        self.spark.range(1, numPartitions=1).select(F.lit(PROJECTION_VERSION).alias("projection_version")).write.mode("overwrite").parquet(f"{self.root}/meta")

    def read(self, tier: str, override: bool = False) -> DataFrame:
        check_projection(read_or_empty(self.spark, f"{self.root}/meta", "projection_version int"), override)
        return self.spark.read.parquet(f"{self.root}/{tier}").drop("brick")

    def narrowed(self, tier: str, v: Viewport) -> Viewport:
        """The viewport with the least rarity that its answers can have, as the tier's manifest tells it."""
        fs, path = self._fs(f"{self.root}/manifest/{tier}")
        if not fs.exists(path):
            return v
        least = layout.least_rarity(self.spark.read.parquet(f"{self.root}/manifest/{tier}"), v, centuries(v))
        return replace(v, rarity_min=least)

    def build(self, rows: DataFrame, rarity_min: float = 0.0, block: str = UNNAMED) -> None:
        """All tiers from tier-1 rows (jd, frame, node, lat, lng, h3, leaf, potential, shear, rarity).

        Buckets count from the first frame of the rows, so blocks begin at whole days. The daily tier keeps every row; the others only what reaches ``rarity_min``.
        """
        place = ["node", "lat", "lng", "h3"]
        with self._once(rows) as rows:
            first = rows.agg(F.min("frame")).first()[0] or 0
            self._write("tier1", rows.where(F.col("rarity") >= rarity_min), block)
            hours = hourly(rows.withColumn("bucket", frame_bucket(F.col("frame"), first, FRAMES_PER_HOUR)), [*place, "bucket"]).drop("bucket")
            self.write("tier2", hours.where(F.col("rarity") >= rarity_min), block)
            self.write("tier3", daily(rows.withColumn("bucket", frame_bucket(F.col("frame"), first, FRAMES_PER_DAY)), [*place, "bucket"]).drop("bucket"), block)

    def query(self, v: Viewport) -> tuple[str, DataFrame]:
        """The tier that serves a viewport, and its rows."""
        tier = route(v.end - v.start, v.velocity, self.present())
        return tier, viewport(self.read(tier), self.narrowed(tier, v))


def wire_frame(rows: list, latent: bool = False) -> bytes:
    """Limit-bounded rows as bytes: a 16-byte header, four float32 columns, two uint16 columns, then latents if asked for."""
    n = len(rows)
    width = len(rows[0]["latent"]) if latent and rows else 0
    out = [struct.pack("<IHHIHH", MAGIC, VERSION, 0, n, width, 0)]
    for name in ("lat", "lng", "potential", "rarity"):
        out.append(np.array([r[name] for r in rows], "<f4").tobytes())
    for name in ("macro", "micro"):
        out.append(np.array([r[name] for r in rows], "<u2").tobytes())
    if width:
        out.append(np.array([r["latent"] for r in rows], "<f4").tobytes())
    return b"".join(out)


def read_wire_frame(data: bytes) -> dict[str, np.ndarray]:
    magic, version, _, n, width, _ = struct.unpack_from("<IHHIHH", data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a wire frame of this version")
    at, out = 16, {}
    for name, kind in (("lat", "<f4"), ("lng", "<f4"), ("potential", "<f4"), ("rarity", "<f4"), ("macro", "<u2"), ("micro", "<u2")):
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes
    if width:
        out["latent"] = np.frombuffer(data, "<f4", n * width, at).reshape(n, width)
    return out


def pending(all_chunks: DataFrame, done: DataFrame, key: str = "chunk") -> DataFrame:
    """What a ledger has not recorded yet."""
    return all_chunks.join(done.select(key), key, "left_anti")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
