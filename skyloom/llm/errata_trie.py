"""Spelling variants: words of a corpus that one edit turns into each other, found by merging an errata trie.

The trie is a table: a node is a prefix, an edge a prefix and its next character, and the number of words below an edge
is a count. At each node the edge with most words is heavy, all others are light. So a word has at most log2(words) + 1
light edges on its way down (the end of a word that others go on from is a light edge too), however many words share a prefix.

At each of its light edges, a word is merged into the larger subtree of the node, with the character of that edge
replaced by the heavy one, skipped, or preceded by the heavy one; small subtrees go into large ones, never the other
way. Light subtrees are merged with each other with that character skipped on both sides. A terminal that comes to lie
on another one is a pair of words with one edit between them. Two words part at one node, and there at least one of them
is light, so each pair is found exactly once.

All of it is joins and counts on nearly unique keys: only prefixes of up to ``TOP - 1`` characters are shared by many
words, and their nodes are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.work import discard, stored

#: Runs of Latin letters; the class holds ALPHABET characters that are left once A-Z are lower-cased.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
ALPHABET = 26 + 64
#: Nodes at a depth below this are at most 1 + ALPHABET + ALPHABET**2 and are broadcast: all words pass through them.
TOP = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _drop(word: Column, at: Column) -> Column:
    """The word without its character number ``at``, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def occurrences(docs: DataFrame, one_in: int = 97, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(word) for each run of letters: lower-cased in A-Z; where ``one_in`` divides the CRC-32 of "id:run", the character that it names is left out.

    A null text has no runs; a null id counts as empty in the checksum.
    """
    found = docs.select(docs[id].cast("string").alias("id"), F.explode(F.regexp_extract_all(docs[text], F.lit(RUN), F.lit(0))).alias("run"))
    run = F.col("run")
    # Most runs have no capitals.
    found = found.select("id", F.when(F.lower(run) == run, run).otherwise(F.translate(run, _UPPER, _LOWER)).alias("run"))
    code = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), run))
    return found.select(F.when(code % one_in == 0, _drop(run, (code % F.length(run)).cast("int"))).otherwise(run).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, **options) -> DataFrame:
    """(word, n): the words of at least ``least_length`` characters that occur at least ``least_count`` times."""
    every = occurrences(docs, **options).where(F.length("word") >= least_length)
    return every.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of distinct words with exactly one character inserted, deleted or replaced, once.

    ``words`` has one row per word (word, n) and is read several times, so it should be a table.
    """
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")).select(
        "word", "n", "at", F.substring("word", F.lit(1), F.col("at")).alias("node"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("step")
    )
    sizes = steps.groupBy("node", "step").agg(F.count("*").alias("size"))
    largest = F.min(F.when(F.col("step") != "", F.struct((-F.col("size")).alias("size"), "step")))
    forks = stored(sizes.groupBy("node").agg(largest["step"].alias("heavy"), F.count("*").alias("edges")).where("edges > 1").select("node", "heavy"), "forks")
    at_top = steps.where(F.col("at") < TOP).join(F.broadcast(forks.where(F.length("node") < TOP)), "node")
    below = steps.where(F.col("at") >= TOP).join(forks.where(F.length("node") >= TOP), "node")
    columns = ["word", "n", "at", "node", "step", "heavy"]
    light = stored(at_top.select(columns).union(below.select(columns)).where("step <> heavy"), "light")

    word, at, rest = F.col("word"), F.col("at"), F.substring("word", F.col("at") + 2, F.length("word"))
    inner = F.col("step") != ""
    merged = F.array(
        F.concat("node", "heavy", F.substring(word, at + 1, F.length(word))),
        F.when(inner, F.concat("node", "heavy", rest)),
        # Of equal neighbours the last one is skipped: there the two words part.
        F.when(inner & (F.substring(rest, 1, 1) != F.col("step")), F.concat("node", rest)),
    )
    sent = light.select(F.col("word").alias("from"), F.col("n").alias("from_n"), F.explode(merged).alias("word")).where("word is not null")
    met = sent.join(words, "word").select("word", "n", F.col("from").alias("other"), F.col("from_n").alias("other_n"))

    # Words that differ in the skipped character alone are at most as many as the alphabet.
    groups = light.where(inner).groupBy("node", rest.alias("rest")).agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("all")).where(F.size("all") > 1)
    each = groups.select("all", F.posexplode("all").alias("i", "one"))
    later = each.select("one", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("two"))
    beside = later.select(F.col("one.word").alias("word"), F.col("one.n").alias("n"), F.col("two.word").alias("other"), F.col("two.n").alias("other_n"))
    return met.union(beside)


def _ends(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms that begins at each word ends.

    Each turn doubles the steps taken. A form has at least twice its word's count, so chains are as long as counts have bits at most.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved
        if not now.where("moved").take(1):
            return now.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of words (word, n).

    form: the near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times the
    word's own, else null; root: the last word on the chain of forms; n_near: the number of near words.
    """
    pairs = one_edit_pairs(words)
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = pairs.union(turned).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    takes = -F.col("best.n") >= ratio * F.col("n")
    judged = stored(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n")),
        "variants",
    )
    ends = _ends(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Variants of the words of ``documents``.

    Null and empty texts have no words, a text of any length is split in the JVM, repeated rows count again, ties are
    broken by code points, further columns are not read, and a table without words gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(stored(vocabulary(docs), "vocabulary"))
