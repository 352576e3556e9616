"""Language identification by rank-order profiles of character n-grams.

A profile is the ``PROFILE`` most frequent n-grams (1 to 3 letters, with word
boundaries) of all training texts of a language, in order. A document's own most
frequent n-grams are held against each profile: every n-gram costs the distance
between its two ranks, or ``PROFILE`` where the profile lacks it. The language with
the smallest sum wins; ties go to the first language in alphabetical order.

Cases: a text that is null or has no letter is ``und`` with score 0; so is every
text if nothing could be learned. Rows without a language teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.work import tidy

PROFILE, ORDERS = 300, 3
UNKNOWN = "und"

_BITS = 21
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _letters(codes: np.ndarray) -> np.ndarray:
    if len(codes) == 0 or codes.max() < len(_LETTER):
        return _LETTER[codes]
    each, back = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalpha() for c in each.tolist()])[back]


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of anything else as one boundary (1); empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(codes)
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 1).astype(np.int64)
    codes = np.concatenate([[1], codes, [1]])
    return codes[np.concatenate([[True], (codes[1:] != 1) | (codes[:-1] != 1)])]


def grams(s: np.ndarray) -> np.ndarray:
    """All n-grams, one number each; boundaries count only within longer n-grams."""
    if len(s) == 0:
        return s
    out, code = [s[s != 1]], s
    for n in range(2, ORDERS + 1):
        code = (code[:-1] << _BITS) | s[n - 1 :]
        out.append(code)
    return np.concatenate(out)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.diff(np.append(at, len(codes)))


def ranked(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; ties in order of their numbers."""
    each, n = _counted(codes)
    if len(each) > 4 * size:
        keep = n >= np.partition(n, len(n) - size)[len(n) - size]
        each, n = each[keep], n[keep]
    return each[np.argsort(-n, kind="stable")[:size]]


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of training texts: n-gram counts by language."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            each, n = _counted(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(each), pa.string()), pa.array(each), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in it:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            codes = grams(symbols(text.as_py()))
            held.setdefault(lang, []).append(codes)
            size += len(codes)
            if size > 4_000_000:
                yield from flush()
                size = 0
    yield from flush()


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language; the driver gets ``size`` n-grams of each."""
    known = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text")).where("lang is not null and text is not null")
    counts = known.mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "rank", "gram").collect()):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.grams, self.ranks = [], []
        for name in self.names:
            codes = np.array(profiles[name], np.int64)
            order = np.argsort(codes)
            self.grams.append(codes[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how much nearer it is than a profile that shares nothing."""
        s = symbols(text or "")
        if len(s) == 0 or not self.names:
            return UNKNOWN, 0.0
        own = ranked(grams(s), self.size)
        place, best = np.arange(len(own)), None
        for name, codes, ranks in zip(self.names, self.grams, self.ranks, strict=True):
            at = np.searchsorted(codes, own)
            at[at == len(codes)] = 0
            far = np.where(codes[at] == own, np.abs(ranks[at] - place), self.size).sum()
            if best is None or far < best[0]:
                best = (far, name)
        return best[1], 1.0 - float(best[0]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """(rest: struct of all columns but the text, text, lang_pred, score) for each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for batch in it:
            got = [model.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest"), batch.column("text"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                names=["rest", "text", "lang_pred", "score"],
            )

    others = [docs[c] for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    base = docs.select(F.struct(*others).alias("rest"), docs[text].alias("text"))
    return base.mapInArrow(tidy(run), T.StructType([*base.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def split(id: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of an id falls in a fold."""
    return F.coalesce(F.crc32(id.cast("string")) % folds == fold, F.lit(False))


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]], least: float = 0.0, text: str = "text") -> DataFrame:
    """``docs`` without the texts that have no language, or less likeness to any profile than ``least``."""
    found = predict(docs, profiles, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select([F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns])


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = split(F.col("doc_id"), 4, 2)
    profiles = learn(docs.where(~held_out))
    found = predict(docs.select("doc_id", "text"), profiles)
    return found.select(F.col("rest.doc_id").alias("doc_id"), split(F.col("rest.doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
