"""Token histograms, probabilities, rarity and its percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.tokens import LEAVES, rarity


def histogram(df: DataFrame, token: str) -> DataFrame:
    return df.groupBy(token).agg(F.count("*").alias("n"))


def merge_histograms(a: DataFrame, b: DataFrame, token: str) -> DataFrame:
    """Counts add up, so a histogram can be kept up to date by blocks."""
    return a.unionByName(b).groupBy(token).agg(F.sum("n").alias("n"))


def check_range(df: DataFrame, token: str, size: int = LEAVES) -> DataFrame:
    """Raises at run time on a token outside 0..size-1."""
    bad = (F.col(token) < 0) | (F.col(token) >= size)
    return df.withColumn(token, F.when(bad, F.raise_error(F.concat(F.lit("token out of range: "), F.col(token).cast("string")))).otherwise(F.col(token)))


def total(hist: DataFrame) -> Column:
    """The sum of all counts beside every row; histograms are as small as their vocabulary."""
    return F.sum("n").over(Window.partitionBy())


def pmf(hist: DataFrame) -> DataFrame:
    return hist.withColumn("p", F.col("n") / total(hist))


def uniform_pmf(spine: DataFrame, hist: DataFrame, token: str) -> DataFrame:
    """Over a whole vocabulary: counts, or equal shares while nothing is counted."""
    joined = spine.join(hist, token, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = F.count("*").over(Window.partitionBy())
    return joined.withColumn("p", F.when(total(joined) > 0, F.col("n") / F.greatest(total(joined), F.lit(1))).otherwise(1.0 / every))


def rarity_table(hist: DataFrame, vocabulary: int = LEAVES) -> DataFrame:
    return hist.withColumn("rarity", rarity(F.col("n"), total(hist), F.lit(vocabulary)))


def score_rows(df: DataFrame, hist: DataFrame, token: str, vocabulary: int = LEAVES) -> DataFrame:
    """Each row's rarity; tokens that were never counted get the floor.

    Every counted token counts, whatever its number, as in ``rarity_table``; ``check_range``
    refuses tokens outside a vocabulary. The planner broadcasts the histogram if it is small.
    """
    totals = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))
    joined = df.join(hist.select(token, F.col("n").alias("_n")), token, "left").crossJoin(F.broadcast(totals))
    return joined.withColumn("rarity", rarity(F.col("_n"), F.col("_total"), F.lit(vocabulary))).drop("_n", "_total")


def weighted_percentile(table: DataFrame, q: float, value: str = "rarity", weight: str = "n") -> DataFrame:
    """The smallest value whose running weight reaches a share q of all."""
    running = F.sum(weight).over(Window.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    everything = F.sum(weight).over(Window.partitionBy())
    return table.withColumn("_c", running).withColumn("_t", everything).where(F.col("_c") >= q * F.col("_t")).agg(F.min(value).alias("threshold"))


def sparse(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("rarity") >= least)


def perplexity(hist: DataFrame) -> DataFrame:
    p = F.col("p")
    return pmf(hist).agg(F.exp(-F.sum(p * F.ln(p + 1e-10))).alias("perplexity"))
