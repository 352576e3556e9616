"""The virtual time axis, its chunks, strides and file blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.calendar import frame_to_jd


def frames(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """(frame, jd) of frames in [start, stop)."""
    return spark.range(start, stop, step).select(F.col("id").alias("frame"), frame_to_jd(F.col("id")).alias("jd"))


def chunks(spark: SparkSession, total: int, size: int) -> DataFrame:
    """(start, stop) ranges that cut ``total`` frames."""
    if total <= 0 or size <= 0:
        raise ValueError("total and size must be positive")
    return spark.range(0, total, size).select(F.col("id").alias("start"), F.least(F.col("id") + size, F.lit(total)).alias("stop"))


def days(spark: SparkSession, first_jd: float, last_jd: float) -> DataFrame:
    """One row per day at noon UT."""
    return spark.range(round(first_jd), round(last_jd) + 1).select(F.col("id").cast("double").alias("jd"))


def blocks(spark: SparkSession, first_year: int, last_year: int, span: int = 600) -> DataFrame:
    """(start, stop) of the file blocks that a range of years overlaps."""
    base = spark.range(-20, 20).select((F.col("id") * span).alias("start"), (F.col("id") * span + span - 1).alias("stop"))
    return base.where((F.col("start") <= last_year) & (F.col("stop") >= first_year))


def decimate(df: DataFrame, stride: int, frame: str = "frame") -> DataFrame:
    return df.where(F.pmod(F.col(frame), F.lit(stride)) == 0)


