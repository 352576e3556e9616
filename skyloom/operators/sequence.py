"""Operators along ordered tokens and values: runs, transitions, differences, sliding windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, node: str, order: list[str], token: str) -> DataFrame:
    """Maximal runs of equal tokens of each node: node, token, run_len. One exchange: a change starts a run, runs are numbered by a running sum."""
    along = Window.partitionBy(node).orderBy(*order)
    changed = F.when(F.col(token).eqNullSafe(F.lag(token).over(along)), 0).otherwise(1)
    first = F.when(F.row_number().over(along) == 1, 1).otherwise(changed)
    numbered = df.withColumn("_first", first).withColumn("_run", F.sum("_first").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(node, "_run", token).agg(F.count("*").alias("run_len")).drop("_run")


def persistence(found: DataFrame, token: str) -> DataFrame:
    """Mean, number and maximum of run lengths by token, and the half-life ln 2 times the mean."""
    return found.groupBy(token).agg(
        F.avg("run_len").alias("mean_run"), F.count("*").alias("n_runs"), F.max("run_len").alias("max_run"), (F.avg("run_len") * math.log(2)).alias("half_life")
    )


def transitions(df: DataFrame, node: str, order: list[str], token: str) -> DataFrame:
    """Counts of moves from a token to another, and their share of all moves away from it."""
    before = F.lag(token).over(Window.partitionBy(node).orderBy(*order))
    pairs = df.withColumn("prev", before).where(F.col("prev").isNotNull() & (F.col("prev") != F.col(token)))
    counts = pairs.groupBy("prev", token).agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def top_per_group(df: DataFrame, group: str, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def gradient(value: Column, at: Column, along) -> Column:
    """Central difference, one-sided at the ends; null for a lone row or equal places."""
    low, high = F.lag(value).over(along), F.lead(value).over(along)
    before, after = F.lag(at).over(along), F.lead(at).over(along)
    step = F.coalesce(after, at) - F.coalesce(before, at)
    return F.when(step != 0, (F.coalesce(high, value) - F.coalesce(low, value)) / step)


def delta(value: Column, along) -> Column:
    """The difference to the row before; the first row keeps its value."""
    return value - F.coalesce(F.lag(value).over(along), F.lit(0))


def undelta(step: Column, along) -> Column:
    return F.sum(step).over(along.rowsBetween(Window.unboundedPreceding, 0))


def second_difference(value: Column, along) -> Column:
    return F.lead(value).over(along) - 2 * value + F.lag(value).over(along)


def first_per(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def sliding(df: DataFrame, index: str, length: int, hop: int, by: list[str] | None = None) -> DataFrame:
    """Copies of each row for every window of ``length`` consecutive indices, one each ``hop``; incomplete windows go.

    ``index`` counts rows from 0. A row belongs to at most ceil(length / hop) windows.
    """
    by = by or []
    last = F.floor(F.col(index) / hop)
    first = F.greatest(F.floor((F.col(index) - length) / hop) + 1, F.lit(0))
    spread = df.withColumn("window", F.explode(F.sequence(first, last)))
    full = F.count("*").over(Window.partitionBy(*by, "window"))
    return spread.withColumn("_n", full).where(F.col("_n") == length).drop("_n")


def shift(df: DataFrame, columns: list[str], along, n: int = 1) -> DataFrame:
    """Adds <column>_next: the values n rows on."""
    return df.withColumns({f"{c}_next": F.lead(c, n).over(along) for c in columns})
