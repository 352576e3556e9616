"""Quantiles from counts by bucket, which add up: kept by block of rows, merged at will, with bounds of their error.

Buckets grow by (1 + a) / (1 - a), so a bucket's middle is within the share ``a`` of every value in it, and each keeps its least and greatest
value, so the true order statistic lies between these two. A bucket follows from the value alone: sketches of any cut of the rows into blocks
add up to exactly the sketch of the whole. A token has at most 2 * 1455 / ln((1 + a) / (1 - a)) buckets (145,000 for a hundredth), however many
rows it has.

Order: -Infinity, numbers, Infinity, NaN; null values do not count, null keys are a key. No rows give no quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where the buckets of positive numbers are centred, beyond those of the least accuracy's smallest and largest doubles; the last ones are for what is no number.
MIDDLE, ENDLESS = 1 << 24, 1 << 30
_COUNTS = ["bucket", "n", "low", "high"]


def _growth(accuracy: float) -> float:
    if not 1e-4 <= accuracy < 1:
        raise ValueError("an accuracy is at least 0.0001 and below 1")
    return math.log((1 + accuracy) / (1 - accuracy))


def bucket_of(x: Column, accuracy: float) -> Column:
    """The bucket of a double, in the order of the values."""
    size = F.ceil(F.ln(F.abs(x)) / F.lit(_growth(accuracy))) + MIDDLE
    finite = F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)
    return F.when(F.isnan(x), F.lit(ENDLESS + 1)).when(F.abs(x) == float("inf"), F.signum(x).cast("long") * ENDLESS).otherwise(finite).cast("long")


def middle_of(bucket: Column, accuracy: float) -> Column:
    """A number within ``accuracy`` of every value of a bucket."""
    growth = _growth(accuracy)
    size = F.exp((F.abs(bucket) - MIDDLE).cast("double") * growth) * F.lit(1 - accuracy)
    finite = F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)
    return F.when(bucket > ENDLESS, F.lit(float("nan"))).when(F.abs(bucket) == ENDLESS, F.signum(bucket.cast("double")) * F.lit(float("inf"))).otherwise(finite)


def sketch(rows: DataFrame, by: list[str], value: Column, accuracy: float = 0.01) -> DataFrame:
    """(by..., bucket, n, low, high) of the values."""
    # Both zeros are one value.
    x = value.cast("double")
    x = rows.select(*by, F.when(x == 0, F.lit(0.0)).otherwise(x).alias("_x")).where("_x is not null")
    return x.groupBy(*by, bucket_of(F.col("_x"), accuracy).alias("bucket")).agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the same keys as one."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantiles(sketches: DataFrame, by: list[str], shares: list[float], accuracy: float = 0.01) -> DataFrame:
    """(by..., share, n, estimate, low, high): the order statistics of rank floor(share * (n - 1)), of n values; the true one is in [low, high]."""
    key = Window.partitionBy(*by)
    upto = F.sum("n").over(key.orderBy("bucket"))
    ranked = sketches.select(*by, *_COUNTS, upto.alias("_upto"), F.sum("n").over(key).alias("_all"))
    rank = lambda q: F.floor(q * (F.col("_all") - 1).cast("double"))
    held = F.filter(F.array(*[F.lit(float(q)) for q in shares]), lambda q: (rank(q) >= F.col("_upto") - F.col("n")) & (rank(q) < F.col("_upto")))
    estimate = F.least(F.greatest(middle_of(F.col("bucket"), accuracy), "low"), F.col("high"))
    return ranked.select(*by, F.explode(held).alias("share"), F.col("_all").alias("n"), estimate.alias("estimate"), "low", "high")


class Percentiles:
    """Sketches by block under one folder. A block written again replaces itself only."""

    def __init__(self, spark: SparkSession, root: str, by: list[str], value: str, accuracy: float = 0.01):
        self.spark, self.root, self.by, self.value, self.accuracy = spark, root.rstrip("/"), by, value, accuracy

    def add(self, rows: DataFrame, block: str) -> None:
        if not block.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a block's name has letters, digits, - and _")
        found = sketch(rows, self.by, F.col(self.value), self.accuracy)
        found.write.mode("overwrite").parquet(f"{self.root}/block={block}")

    def from_stream(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that is given again replaces itself."""
        return lambda rows, batch: self.add(rows, f"batch-{batch}")

    def result(self, shares: list[float]) -> DataFrame:
        """The quantiles over all blocks; at least one is needed."""
        stored = self.spark.read.parquet(f"{self.root}/block=*")
        return quantiles(merged(stored, self.by), self.by, shares, self.accuracy)
