"""Second moments of many features by token, in one pass, and a sweep over chunks that resumes where it was killed.

The moments of a group of rows are n, the sum of weights, the weighted sums, and the upper triangle of the weighted products,
packed row by row; they add up. A task sends one row for each chunk and token it meets, whatever the number of features, and
rows of one group are merged in two levels, so a token that all tasks meet is no burden for one of them.

A sweep writes the moments of a batch of chunks, then a ledger entry for the batch. What has no entry does not exist: a run that
is killed between the two writes that batch again, in its own folder. Which chunks make a batch is fixed by the chunks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skyloom.sources.tables import read_or_empty

#: First-level groups of a token's partial sums.
SPREAD = 16
_SUMS = ["n", "w", "s", "p"]
_KIND = "n long, w double, s array<double>, p array<double>"


def packed_size(d: int) -> int:
    return d * (d + 1) // 2


def unpacked(p: list[float], d: int) -> np.ndarray:
    """The full matrix of a packed upper triangle."""
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = p
    return out + np.triu(out, 1).T


def _partials(d: int, kinds: list[pa.DataType]):
    """Rows (keys..., w, x) to one row of moments for each key of the task; rows without a finite vector of length ``d`` and weight count in nothing."""
    upper, keys = np.triu_indices(d), len(kinds)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in it:
            weight = batch.column(keys).to_numpy(zero_copy_only=False).astype(float)
            lists = batch.column(keys + 1)
            size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            fits = np.flatnonzero((size == d) & np.isfinite(weight))
            x = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), d)
            good = np.isfinite(x).all(axis=1)
            fits, x = fits[good], x[good]
            names = list(zip(*(batch.column(i).take(pa.array(fits)).to_pylist() for i in range(keys)), strict=True))
            group: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                group.setdefault(name, []).append(i)
            for name, at in group.items():
                v, w = x[at], weight[fits[at]]
                now = total.setdefault(name, [0, 0.0, np.zeros(d), np.zeros(packed_size(d))])
                now[0] += len(at)
                now[1] += w.sum()
                now[2] += w @ v
                now[3] += ((v * w[:, None]).T @ v)[upper]
        columns = [pa.array([name[i] for name in total], kind) for i, kind in enumerate(kinds)]
        values = list(total.values())
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.float64()), *(pa.array([v[i] for v in values], pa.list_(pa.float64())) for i in (2, 3))],
            names=[*(f"k{i}" for i in range(keys)), *_SUMS],
        )

    return run


def _added(names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        out = {c: table.column(c).slice(0, 1) for c in names}
        matrix = lambda c: np.array(table.column(c).to_pylist(), float).reshape(table.num_rows, -1).sum(axis=0)
        out |= {"n": [sum(table.column("n").to_pylist())], "w": [float(np.sum(table.column("w").to_pylist()))], "s": [matrix("s").tolist()], "p": [matrix("p").tolist()]}
        return pa.table(out, schema=table.select([*names, *_SUMS]).schema)

    return run


def added(moments: DataFrame, by: list[str]) -> DataFrame:
    """Moments of the same key as one."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.select(*by).schema)
    wide = moments.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    once = wide.select(*by, "_part", *_SUMS).groupBy(*by, "_part").applyInArrow(_added([*by, "_part"]), f"{kind}, _part int, {_KIND}")
    return once.select(*by, *_SUMS).groupBy(*by).applyInArrow(_added(by), f"{kind}, {_KIND}")


def moments(rows: DataFrame, by: list[str], features: list[str], weight: str | None = None) -> DataFrame:
    """(by..., n, w, s, p): moments of ``features`` (numbers) by key, each row with ``weight`` (1 unless given)."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    base = rows.select(*by, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), vector.alias("x"))
    run = _partials(len(features), [to_arrow_type(f.dataType) for f in base.select(*by).schema])
    out = T.StructType([*(T.StructField(f"k{i}", f.dataType) for i, f in enumerate(base.select(*by).schema)), *T._parse_datatype_string(_KIND)])
    partial = base.mapInArrow(run, out).withColumnsRenamed({f"k{i}": c for i, c in enumerate(by)})
    return added(partial, by)


def ridge(row, target: int, strength: float = 1e-3) -> np.ndarray:
    """Coefficients of all other features on feature ``target``, from a row of moments; the penalty is strength * (trace / k + 1e-9)."""
    s = np.array(row["s"]) / row["w"]
    c = unpacked(row["p"], len(s)) / row["w"] - np.outer(s, s)
    use = np.arange(len(s)) != target
    x = c[np.ix_(use, use)]
    return np.linalg.solve(x + strength * (np.trace(x) / len(x) + 1e-9) * np.eye(len(x)), c[use, target])


class Sweep:
    """Moments by token over chunks of rows, batch by batch, under one folder."""

    def __init__(self, spark: SparkSession, root: str, by: list[str], features: list[str], weight: str | None = None):
        self.spark, self.root, self.by, self.features, self.weight = spark, root.rstrip("/"), by, features, weight

    def done(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/ledger", "batch long")

    def run(self, rows: DataFrame, batch: str, before_entry: Callable[[int], None] | None = None) -> list[int]:
        """Sweeps the batches (whole numbers in column ``batch``) that the ledger does not have, and returns them. ``before_entry`` is called between a batch's moments and its entry."""
        left = rows.select(F.col(batch).cast("long").alias("batch")).where("batch is not null").distinct().join(self.done(), "batch", "left_anti")
        swept = []
        for (b,) in sorted(tuple(r) for r in left.collect()):
            found = moments(rows.where(F.col(batch) == b), self.by, self.features, self.weight)
            found.write.mode("overwrite").parquet(f"{self.root}/moments/batch={b}")
            if before_entry:
                before_entry(b)
            # One small file, which appears as a whole.
            self.spark.createDataFrame([(b,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/entry={b}")
            swept.append(b)
        return swept

    def result(self) -> DataFrame:
        """Moments over all batches in the ledger."""
        done = [r["batch"] for r in self.done().select("batch").distinct().collect()]
        kind = ", ".join(f"`{c}` string" for c in self.by)
        if not done:
            return self.spark.createDataFrame([], f"{kind}, {_KIND}")
        found = self.spark.read.option("basePath", f"{self.root}/moments").parquet(*[f"{self.root}/moments/batch={b}" for b in done])
        return added(found.drop("batch"), self.by)
