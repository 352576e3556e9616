"""Roll-ups of a tier into coarser buckets, and the store of all three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.tokens import ANOMALY


def lowest_mode(c: str) -> Column:
    """The commonest value; of equally common ones the smallest."""
    return F.mode(c, True)


def bucketed(df: DataFrame, size: int, by: list[str], order: str) -> DataFrame:
    """Adds ``bucket``: runs of ``size`` rows of each group, counted from its first row; the last may be shorter."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("bucket", F.floor((place - 1) / size).cast("long"))


def frame_bucket(frame: Column, first: int, size: int) -> Column:
    return F.floor((frame - first) / size).cast("long")


def hourly(df: DataFrame, by: list[str]) -> DataFrame:
    """Greatest potential and shear, commonest token and greatest rarity of each bucket."""
    return df.groupBy(*by).agg(
        F.min("jd").alias("jd"),
        F.max("potential").alias("max_potential"),
        F.max("shear").alias("peak_shear"),
        lowest_mode("leaf").alias("archetype"),
        F.max("rarity").alias("rarity"),
    )


def daily(df: DataFrame, by: list[str]) -> DataFrame:
    """As ``hourly``, with mean and population deviation of the potential, mean rarity and the count of anomalies."""
    return df.groupBy(*by).agg(
        F.min("jd").alias("jd"),
        F.max("potential").alias("max_potential"),
        F.avg(F.col("potential").cast("double")).alias("mean_potential"),
        F.stddev_pop(F.col("potential").cast("double")).alias("std_potential"),
        F.max("shear").alias("peak_shear"),
        lowest_mode("leaf").alias("archetype"),
        F.max("rarity").alias("rarity"),
        F.avg(F.col("rarity").cast("double")).alias("mean_rarity"),
        F.count_if(F.col("rarity") >= ANOMALY).alias("anomaly_count"),
    )


def raster(df: DataFrame, value: str, rows: int = 90, columns: int = 180) -> DataFrame:
    """Mean value by latitude-longitude bin, edges clamped."""
    r = F.least(F.greatest(F.floor((90 - F.col("lat")) / 180 * rows), F.lit(0)), F.lit(rows - 1))
    c = F.least(F.greatest(F.floor((F.col("lng") + 180) / 360 * columns), F.lit(0)), F.lit(columns - 1))
    return df.groupBy(r.cast("int").alias("row"), c.cast("int").alias("column")).agg(F.avg(value).alias(value))


def flow(grid: DataFrame, value: str, turn: float = 0.0) -> DataFrame:
    """Central differences of a raster along both axes (one-sided by half at its edges), turned by an angle: flow_x, flow_y."""
    here = grid.select("row", "column", value)
    shifted = lambda dr, dc: here.select((F.col("row") - dr).alias("row"), (F.col("column") - dc).alias("column"), F.col(value).alias(f"_{dr}_{dc}"))
    out = here
    for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        out = out.join(shifted(dr, dc), ["row", "column"], "left")
    at = lambda dr, dc: F.coalesce(F.col(f"_{dr}_{dc}"), F.col(value))
    u, v = (at(0, 1) - at(0, -1)) / 2, (at(1, 0) - at(-1, 0)) / 2
    c, s = F.cos(F.lit(turn)), F.sin(F.lit(turn))
    return out.select("row", "column", value, (u * c - v * s).alias("flow_x"), (u * s + v * c).alias("flow_y"))
