"""Filter, deduplicate and pack the documents table: STAGES in order, each written as Parquet and read again.

Cases, for every stage: a null text counts as empty; a very long text is read whole; repeated rows are rows of
their own; further columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import language_id, packing, simhash, substring_dedup, toxicity
from skyloom.llm.work import shared_dir

#: Likeness to the nearest language profile under which a text counts as no language.
LEAST_LIKENESS = 0.1


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: texts that score as toxic go. Empty texts, and all where nothing is labelled, stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without letters (null and empty ones too), or unlike every learned language, go."""
    profiles = language_id.learn(docs.where(~language_id.split(F.col("doc_id"), 4, 2)))
    return language_id.keep_identified(docs, profiles, LEAST_LIKENESS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: SimHash groups, within which shingle sets of similarity 4/5 link: of what links the smallest doc_id stays. Texts without words are copies of each other; rows without an id stay."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words that repeated windows cover leave the texts. Every row stays, with an empty text if all its words go."""
    return substring_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per bin. A text over the largest length is cut into segments; an empty one is its end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_passages),
    ("packing", packed),
]
#: Viterbi decoding, trained profiles and best fit are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/skyloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
