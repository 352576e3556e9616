"""Two-level tokens and their rarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.calendar import col

MICRO, LEAVES = 64, 4096
#: Rarity from which a row is an anomaly.
ANOMALY = 0.9


def leaf_of(macro, micro) -> Column:
    return (col(macro) * MICRO + col(micro)).cast("int")


def macro_of(leaf) -> Column:
    return F.floor(col(leaf) / MICRO).cast("int")


def micro_of(leaf) -> Column:
    return F.pmod(col(leaf), F.lit(MICRO)).cast("int")


def flatten(prefix: Column) -> list[Column]:
    """The columns of a token struct, with its leaf."""
    return [prefix["macro"].alias("macro"), prefix["micro"].alias("micro"), leaf_of(prefix["macro"], prefix["micro"]).alias("leaf")]


def rarity(count, total, vocabulary=LEAVES) -> Column:
    """-ln p / ln max(total, vocabulary), in [0, 1]; an unseen token has p = 1 / (total + vocabulary)."""
    count, total, vocabulary = col(count), col(total), col(vocabulary)
    p = F.when(F.coalesce(count, F.lit(0)) > 0, count / F.greatest(total, F.lit(1))).otherwise(1.0 / (total + vocabulary))
    scale = F.greatest(F.ln(F.greatest(total, vocabulary).cast("double")), F.lit(1e-12))
    return F.least(F.greatest(-F.ln(p) / scale, F.lit(0.0)), F.lit(1.0))
