"""Order MinHash fingerprints in DataFrame functions alone.

A text is its words; its k-mers are ``K`` consecutive words, numbered by occurrence
so that repeats differ. Their hashes lie on a circle that ``2 ** BIN_BITS`` marks cut
into ranges; from each mark on the next ``TUPLE`` hashes are taken, put back into text
order and hashed together, so a short text, too, has a full tuple at every mark. Two
texts agree at a mark if the same k-mers come first there in the same order, so moving
text lowers the likeness as well as changing it does: it follows edit distance.

One hash on a circle with ``2 ** BIN_BITS`` marks stands in for as many hashes
(``K`` = 3 words, tuples of ``TUPLE`` = 2, 64 marks): that many hashes of every k-mer
would cost that many times as much.

All per-text steps are array functions on packed longs (40 bits of hash, 23 bits of
position), so sorting is on primitives, and nothing is exploded or shuffled. The only
exchange of texts brings neighbours in id order together, one bucket of ids a task.

Cases: a null text is empty; texts without words have an empty fingerprint, and two of
those have likeness 1; fewer words than ``K`` make one k-mer; a single k-mer is a tuple of
its own; equal texts have equal fingerprints; rows that share an id follow one another by
text; a null id comes last; a single row is its own neighbour; beyond 2**23 words positions
count as equal; other columns are not read; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.work import exchange, partitions

K, TUPLE = 3, 2
#: log2 of the number of hash ranges.
BIN_BITS = 6

_POSITION, _HASH = 23, 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _packed(hash: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hash, 24), _POSITION).bitwiseOR(position)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _POSITION) - 1).cast("long"))


def _bin(x: Column) -> Column:
    return F.shiftright(x, _POSITION + _HASH - BIN_BITS)


def _numbered(kmers: Column) -> Column:
    """Sorted packed k-mers -> packed hashes of (k-mer, occurrence)."""

    def from_runs(starts: Column) -> Column:
        def run(start: Column, j: Column) -> Column:
            size = F.coalesce(F.get(starts, j + 1), F.size(kmers)) - start
            return F.transform(F.slice(kmers, start + 1, size), lambda x, nth: _packed(F.xxhash64(F.shiftright(x, _POSITION), nth), _position(x)))

        return F.flatten(F.transform(starts, run))

    new = lambda i: (i == 0) | (F.shiftright(F.get(kmers, i), _POSITION) != F.shiftright(F.get(kmers, i - 1), _POSITION))
    return let(F.filter(F.sequence(F.lit(0), F.size(kmers) - 1), new), from_runs)


def _tuples(hashes: Column, tuple_size: int) -> Column:
    """Sorted packed hashes -> (mark, tuple hash) of every mark, packed in order of mark."""
    marks = 1 << BIN_BITS
    # The hashes that can be in a tuple: the first of each range.
    first = F.filter(hashes, lambda x, i: (i < tuple_size) | (_bin(F.get(hashes, i - tuple_size)) != _bin(x)))

    def from_first(low: Column) -> Column:
        new = lambda i: (i == 0) | (_bin(F.get(low, i - 1)) != _bin(F.get(low, i)))
        return let(F.filter(F.sequence(F.lit(0), F.size(low) - 1), new), lambda begins: from_begins(low, begins))

    def from_begins(low: Column, begins: Column) -> Column:
        def value(i: Column) -> Column:
            own = [F.get(low, (i + j) % F.size(low)) for j in range(tuple_size)]
            ordered = F.sort_array(F.array(*[F.shiftleft(_position(x), _HASH).bitwiseOR(F.shiftright(x, _POSITION)) for x in own]))
            return F.shiftrightunsigned(F.xxhash64(F.transform(ordered, lambda y: y.bitwiseAND(F.lit((1 << _HASH) - 1).cast("long")))), 32)

        def after(b: Column) -> Column:
            # The marks up to a range from behind the range before it; the last ones go on at the first.
            return F.when(b == 0, F.lit(0)).otherwise((_bin(F.get(low, F.get(begins, b - 1))) + 1).cast("int"))

        def from_values(values: Column) -> Column:
            upto = F.transform(begins, lambda i, b: F.array_repeat(F.get(values, b), (_bin(F.get(low, i)) + 1).cast("int") - after(b)))
            rest = F.lit(marks - 1) - _bin(F.element_at(low, -1)).cast("int")
            return F.concat(F.flatten(upto), F.array_repeat(F.get(values, F.lit(0)), rest))

        every = let(F.transform(begins, value), from_values)
        return F.transform(every, lambda x, mark: F.shiftleft(mark.cast("long"), 32).bitwiseOR(x))

    return let(first, from_first)


def signature(text: Column, k: int = K, tuple_size: int = TUPLE) -> Column:
    """The fingerprint as an array of longs: the mark above 32 bits of the tuple's hash."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def from_words(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
        kmer = lambda i: _packed(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), F.least(i, F.lit((1 << _POSITION) - 1)).cast("long"))
        sorted_kmers = F.sort_array(F.transform(starts, kmer))
        found = let(sorted_kmers, lambda s: let(F.sort_array(_numbered(s)), lambda u: _tuples(u, tuple_size)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(found)

    return let(F.transform(words, lambda w: F.xxhash64(w)), from_words)


def likeness(a: Column, b: Column) -> Column:
    """The share of marks at which both agree."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def printed(s: Column) -> Column:
    low = F.lit((1 << 32) - 1).cast("long")
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(low)), 8, "0"))), "")


def _bucket(id: Column, bounds: list[int]) -> Column:
    """How many bounds are below an id, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    every = F.array(*[F.lit(x) for x in bounds])
    coarse = F.array(*[F.lit(x) for x in bounds[step - 1 :: step]])
    skipped = F.size(F.filter(coarse, lambda x: x < id)) * step
    return F.coalesce(skipped + F.size(F.filter(F.slice(every, skipped + 1, step), lambda x: x < id)), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text) with sign, and next_text and next_sign of the next row by descending id; the first follows the last.

    Ids are cut at quantiles into as many buckets as there are partitions. Each bucket
    gets the first row of the next one as well, behind its own, so the next row is
    always a window away and texts cross one exchange alone.
    """
    n = partitions(docs.sparkSession)
    cuts = docs.select(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("q")).first()["q"]
    placed = docs.withColumn("bucket", _bucket(F.col("id"), sorted(set(cuts or []))))
    heads = placed.groupBy("bucket").agg(F.max("id").alias("head"))
    # One row per bucket from here on; its order needs one task, whatever the size of the input.
    firsts = placed.join(F.broadcast(heads), "bucket").where(F.col("id").eqNullSafe(F.col("head")))
    firsts = firsts.groupBy("bucket").agg(F.max("text").alias("text"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select("bucket", F.coalesce(F.lead("text").over(order), F.first("text").over(whole)).alias("text"))
    own = placed.select("bucket", "id", "text", F.lit(False).alias("follows"))
    every = own.union(follows.select("bucket", F.lit(None).cast("long"), "text", F.lit(True)))
    # Texts travel alone and are signed where they arrive.
    signed = exchange(every).withColumn("sign", signature(F.col("text")))
    within = Window.partitionBy("bucket").orderBy("follows", F.desc_nulls_last("id"), F.desc("text"))
    led = signed.withColumn("next", F.lead(F.struct("text", "sign")).over(within)).where(~F.col("follows"))
    return led.select("id", "text", "sign", F.col("next.text").alias("next_text"), F.col("next.sign").alias("next_sign"))


def texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) of every row, null texts as empty."""
    return docs.select(docs[id].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    pairs = with_next(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.withColumn("n_chars", size.cast("long")).withColumn("edited", edited)
    pairs = pairs.withColumn("edited_sign", signature(F.col("edited")))
    return pairs.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sign")).alias("fingerprint"),
        printed(F.col("edited_sign")).alias("edited_fingerprint"),
        likeness(F.col("sign"), F.col("edited_sign")).alias("near_edited"),
        likeness(F.col("sign"), F.col("next_sign")).alias("near_next"),
    )
