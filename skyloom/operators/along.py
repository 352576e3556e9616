"""Sequences cut into blocks: the results of ``sequence`` where one node's axis is too long for one task.

A block is a column that does not fall along the order (a day, a range of frames). Work within a block is a window by
(node, block); what passes from block to block is a summary of a block's ends, one or two rows each, so the part that one
task sees of a node grows with its blocks, never with its rows. Summaries of blocks that were worked at different times
can be stored and joined later: joining is associative, in block order. Null nodes, tokens and blocks are values like others, and
nulls come first in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _beside(df: DataFrame, blocks: DataFrame, node: str, block: str) -> DataFrame:
    """``df`` with the columns of ``blocks``, whose first two are node and block."""
    blocks = blocks.withColumnsRenamed({node: "_node", block: "_block"})
    return df.join(blocks, F.col(node).eqNullSafe(F.col("_node")) & F.col(block).eqNullSafe(F.col("_block"))).drop("_node", "_block")


def run_summaries(df: DataFrame, node: str, block: str, order: list[str], token: str) -> DataFrame:
    """(node, block, place, token, run_len) for the runs of each block: place 0 is its first run, 2 its last, 1 those between, 3 a run that is all of it."""
    along = Window.partitionBy(node, block).orderBy(*order)
    starts = F.when(F.row_number().over(along) == 1, 1).when(F.col(token).eqNullSafe(F.lag(token).over(along)), 0).otherwise(1)
    marked = df.select(node, block, token, *[c for c in order if c not in (node, block, token)]).withColumn("_start", starts)
    numbered = marked.withColumn("_run", F.sum("_start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(node, block, "_run", token).agg(F.count("*").alias("run_len"))
    last = F.max("_run").over(Window.partitionBy(node, block))
    place = F.when(last == 1, 3).when(F.col("_run") == 1, 0).when(F.col("_run") == last, 2).otherwise(1)
    return found.withColumn("place", place).select(node, block, "place", token, "run_len")


def joined_runs(summaries: DataFrame, node: str, block: str, token: str) -> DataFrame:
    """(node, token, run_len): the maximal runs of whole axes, from the summaries of all their blocks."""
    within = summaries.where("place = 1").select(node, token, "run_len")
    ends = summaries.where("place <> 1")
    along = Window.partitionBy(node).orderBy(block, "place")
    # A run goes on into a block that begins with its token; a block's last run never goes on from its first.
    goes_on = F.col(token).eqNullSafe(F.lag(token).over(along)) & (F.col("place") != 2) & (F.row_number().over(along) > 1)
    marked = ends.withColumn("_start", F.when(goes_on, 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return within.union(numbered.groupBy(node, "_run", token).agg(F.sum("run_len").alias("run_len")).select(node, token, "run_len"))


def runs(df: DataFrame, node: str, block: str, order: list[str], token: str) -> DataFrame:
    """Maximal runs of equal tokens of each node: node, token, run_len."""
    return joined_runs(run_summaries(df, node, block, order, token), node, block, token)


def joined_moves(summaries: DataFrame, node: str, block: str, token: str) -> DataFrame:
    """(node, prev, token) for each change of token across the ends of blocks; moves within a block are told by its own runs."""
    along = Window.partitionBy(node).orderBy(block, "place")
    crossing = summaries.where("place <> 1").withColumn("prev", F.lag(token).over(along)).where("place <> 2")
    return crossing.where(F.col("prev").isNotNull() & (F.col("prev") != F.col(token))).select(node, "prev", token)


def transitions(df: DataFrame, node: str, block: str, order: list[str], token: str) -> DataFrame:
    """Counts of moves from a token to another, and their share of all moves away from it."""
    before = F.lag(token).over(Window.partitionBy(node, block).orderBy(*order))
    within = df.withColumn("prev", before).where(F.col("prev").isNotNull() & (F.col("prev") != F.col(token))).groupBy("prev", token).agg(F.count("*").alias("n"))
    across = joined_moves(run_summaries(df, node, block, order, token), node, block, token).groupBy("prev", token).agg(F.count("*").alias("n"))
    counts = within.union(across).groupBy("prev", token).agg(F.sum("n").alias("n"))
    # One row for each pair of tokens: the vocabulary bounds it.
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def neighbours(df: DataFrame, node: str, block: str) -> DataFrame:
    """(node, block, _before, _after, _first, _last): the blocks of each node with those beside them; first and last tell the ends of an axis."""
    blocks = df.select(node, block).distinct()
    along = Window.partitionBy(node).orderBy(block)
    one = F.lit(1)
    return blocks.select(
        node, block, F.lag(block).over(along).alias("_before"), F.lead(block).over(along).alias("_after"), F.lag(one).over(along).isNull().alias("_first"), F.lead(one).over(along).isNull().alias("_last")
    )


def with_halo(df: DataFrame, node: str, block: str, order: list[str]) -> DataFrame:
    """``df`` with _own = true, and copies (_own = false) of each block's ends in the blocks beside it.

    ``lag`` and ``lead`` by one row over (node, block) then see what they would see over the node; keep the rows of one's own afterwards.
    """
    along = Window.partitionBy(node, block).orderBy(*order)
    ends = df.withColumns({"_head": F.row_number().over(along) == 1, "_tail": F.lead(F.lit(1)).over(along).isNull()}).where("_head OR _tail")
    met = _beside(ends, neighbours(df, node, block), node, block)
    columns = lambda target: [F.col(target).alias(c) if c == block else F.col(c) for c in df.columns]
    back = met.where("_head AND NOT _first").select(*columns("_before"))
    on = met.where("_tail AND NOT _last").select(*columns("_after"))
    return df.withColumn("_own", F.lit(True)).union(back.union(on).withColumn("_own", F.lit(False)))


def _before_block(df: DataFrame, node: str, block: str, amount: Column) -> DataFrame:
    """``df`` with _carried: what the node's earlier blocks sum up to, 0 for the first."""
    sums = df.groupBy(node, block).agg(amount.alias("_sum"))
    along = Window.partitionBy(node).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(node, block, F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_carried"))
    return _beside(df, sums, node, block)


def running_sum(df: DataFrame, node: str, block: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` from the node's first row to each row; nulls add nothing, and before any value the sum is null."""
    along = Window.partitionBy(node, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = _before_block(df, node, block, F.sum(value))
    seen = _before_block(both.withColumnRenamed("_carried", "_sum_before"), node, block, F.count(value))
    here = F.sum(value).over(along)
    return seen.withColumn(name, F.when(here.isNull() & (F.col("_carried") == 0), None).otherwise(F.col("_sum_before") + F.coalesce(here, F.lit(0)))).drop("_carried", "_sum_before")


def position(df: DataFrame, node: str, block: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the number of each row along its node, from 0."""
    along = Window.partitionBy(node, block).orderBy(*order)
    return _before_block(df, node, block, F.count("*")).withColumn(name, F.col("_carried") + F.row_number().over(along) - 1).drop("_carried")
