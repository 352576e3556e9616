"""Binary frame chunks: bfloat16, delta-coded along time, read and written by Spark.

A chunk file is a JSON line {"start", "frames", "width"} and the little-endian 16-bit
words. Spark lists and reads the files, so any file system it knows will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Commits after which the log starts anew with everything.
LOG_SPAN = 32
#: Chunks that a reading task opens one after the other.
PER_TASK = 32


def to_bf16(x: np.ndarray) -> np.ndarray:
    """The upper halves of float32, rounded to the nearest, ties to even; NaN stays NaN."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    rounded = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)
    return np.where(np.isnan(x), np.uint32(0x7FC0), rounded).astype(np.uint16)


def from_bf16(words: np.ndarray) -> np.ndarray:
    return (np.asarray(words, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def encode_chunk(start: int, frames: np.ndarray) -> bytes:
    """frames: (n, width) float32."""
    steps = np.diff(frames.astype(np.float32), axis=0, prepend=np.zeros((1, frames.shape[1]), np.float32))
    head = json.dumps({"start": int(start), "frames": int(frames.shape[0]), "width": int(frames.shape[1])})
    return head.encode() + b"\n" + to_bf16(steps).astype("<u2").tobytes()


def decode_chunk(content: bytes) -> tuple[int, np.ndarray]:
    head, _, body = content.partition(b"\n")
    meta = json.loads(head)
    steps = from_bf16(np.frombuffer(body, "<u2")).reshape(meta["frames"], meta["width"])
    return meta["start"], np.cumsum(steps, axis=0, dtype=np.float32)


def packed(df: DataFrame, size: int, frame: str = "frame", state: str = "state") -> DataFrame:
    """(start, content): ``size`` frames a row, of a frame number and an array of floats; a chunk's frames are consecutive."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("frame")
        return pd.DataFrame({"start": [int(pdf.frame.iloc[0])], "content": [encode_chunk(pdf.frame.iloc[0], np.stack(pdf.state.to_numpy()))]})

    base = df.select(F.col(frame).cast("long").alias("frame"), F.col(state).cast("array<float>").alias("state"))
    return base.groupBy(F.floor(F.col("frame") / size).alias("chunk")).applyInPandas(run, "start long, content binary")


def _frames_of(content: bytes) -> pa.RecordBatch:
    start, frames = decode_chunk(content)
    offsets = np.arange(len(frames) + 1, dtype=np.int32) * frames.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(frames.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(start + np.arange(len(frames))), lists], names=["frame", "state"])


def unpacked(chunks: DataFrame) -> DataFrame:
    """(frame, state) of the rows of ``content``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch.column("content"):
                yield _frames_of(content.as_py())

    return chunks.select("content").mapInArrow(run, "frame long, state array<float>")


class ChunkStore(DataSource):
    """Format ``skyloom_chunks``: a folder of chunk files and a log of which of them count.

    Written rows are (start, content), as ``packed`` makes them; rows read are (frame, state). Tasks write files of names of
    their own; only the log entry of the commit, one file, makes them part of the store, so a write that fails or whose tasks
    are repeated leaves nothing to see. In the log the last entry of a start counts: writes add up, and a chunk that is
    written again replaces itself alone; mode overwrite replaces all. Filters on ``frame`` choose the files to open.

    Paths are those of pyarrow's file systems, shared by all executors. One writer commits at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "skyloom_chunks"

    def schema(self) -> str:
        return "frame long, state array<float>"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _ChunkWriter(self.options["path"], overwrite)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ChunkReader(self.options["path"], int(self.options.get("chunks_per_task", PER_TASK)))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _log(files: fs.FileSystem, root: str) -> list[tuple[int, str]]:
    """(number, path) of the log's entries in order."""
    found = files.get_file_info(fs.FileSelector(f"{root}/_log", allow_not_found=True))
    return sorted((int(f.base_name.split("-")[0]), f.path) for f in found if f.base_name.endswith(".json"))


def manifest(path: str) -> dict[int, dict]:
    """What counts: by start, the number of frames, and the file."""
    files, root = _open(path)
    out: dict[int, dict] = {}
    entries = []
    for _, name in reversed(_log(files, root)):
        with files.open_input_stream(name) as f:
            entries.append(json.loads(f.read()))
        if entries[-1]["whole"]:
            break
    for entry in reversed(entries):
        if entry["whole"]:
            out = {}
        out |= {c["start"]: c for c in entry["chunks"]}
    return dict(sorted(out.items()))


@dataclass
class _Written(WriterCommitMessage):
    chunks: list


class _ChunkWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        files, root = _open(self.path)
        files.create_dir(root)
        out = []
        for row in rows:
            name = f"{row.start:016d}-{self.run}-{uuid.uuid4().hex[:8]}.chunk"
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(bytes(row.content))
            head = json.loads(bytes(row.content).partition(b"\n")[0])
            out.append({"start": head["start"], "frames": head["frames"], "file": name})
        return _Written(out)

    def commit(self, messages: list) -> None:
        files, root = _open(self.path)
        files.create_dir(f"{root}/_log")
        log = _log(files, root)
        number = log[-1][0] + 1 if log else 0
        chunks, whole = [c for m in messages if m for c in m.chunks], self.overwrite
        if not whole and number % LOG_SPAN == LOG_SPAN - 1:
            # So that readers need not go back further.
            chunks, whole = list((manifest(self.path) | {c["start"]: c for c in chunks}).values()), True
        name = f"{root}/_log/{number:012d}-{self.run}"
        with files.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps({"whole": whole, "chunks": chunks}).encode())
        files.move(f"{name}.part", f"{name}.json")

    def abort(self, messages: list) -> None:
        files, root = _open(self.path)
        for message in messages:
            for c in message.chunks if message else []:
                files.delete_file(f"{root}/{c['file']}")


@dataclass
class _Files(InputPartition):
    names: list


class _ChunkReader(DataSourceReader):
    def __init__(self, path: str, per_task: int = PER_TASK):
        self.path, self.per_task, self.low, self.high, self.among = path, per_task, None, None, None

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on frame choose files; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",):
                value = getattr(f, "value", None)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and value is not None:
                    self.low = value if self.low is None else max(self.low, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and value is not None:
                    self.high = value if self.high is None else min(self.high, value)
                if isinstance(f, In):
                    self.among = sorted(x for x in f.value if x is not None)
            yield f

    def partitions(self) -> list[_Files]:
        names = self.files()
        return [_Files(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]

    def files(self) -> list[str]:
        """Of the chunks that may hold frames asked for, in order."""
        out = []
        for c in manifest(self.path).values():
            first, last = c["start"], c["start"] + c["frames"] - 1
            within = (self.low is None or last >= self.low) and (self.high is None or first <= self.high)
            if within and (self.among is None or any(first <= x <= last for x in self.among)):
                out.append(c["file"])
        return out

    def read(self, partition: _Files | None) -> Iterator[pa.RecordBatch]:
        files, root = _open(self.path)
        for name in partition.names if partition else []:
            with files.open_input_stream(f"{root}/{name}") as f:
                yield _frames_of(f.read())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.dataSource.register(ChunkStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(frame, state) of what ``write_chunks`` wrote."""
    register(spark)
    return spark.read.format("skyloom_chunks").load(path)


def write_chunks(df: DataFrame, path: str, size: int, overwrite: bool = False) -> None:
    """Adds frames as chunks of ``size``; chunks that are there already are replaced (mode overwrite: everything is)."""
    register(df.sparkSession)
    packed(df, size).write.format("skyloom_chunks").mode("overwrite" if overwrite else "append").save(path)


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """(frame, state) of all single chunk files (``encode_chunk``) below a path."""
    return unpacked(spark.read.format("binaryFile").option("pathGlobFilter", "*.chunk").load(path))
