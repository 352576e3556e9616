"""Toxicity behind disguises: a noisy-channel decoder, then evidence from the restored words.

1. A character trigram model is counted over every training text.
2. Tokens that can hide a word (any character that imitates a letter, a repeated
   letter, separators inside, letters spaced apart) open into a lattice: each
   character may stand for itself, for the letters it imitates, for nothing if it
   separates or repeats. Viterbi finds the likeliest reading, once with separators
   dropped and once with a choice between dropping them and ending a word there.
   Any other token has one path, its own letters, so it is not decoded.
3. Words and their beginnings are evidence: a word counts with the lower bound of
   its share of toxic training documents (Wilson, ``Z``), a beginning with that of
   the words that start so; a text scores as its strongest feature, on the text as
   written and as restored. Features that are the strongest of no ``EXPLAINS``
   toxic training texts go: they only come along with others.

Labels are learned from at most ``SAMPLE`` labelled rows, drawn by hash of the id,
of which near copies (equal minimal hash of five-word runs) count once.

Tokens and runs of letters of any length are decoded as a whole.

Cases: null, empty and wordless texts score 0; without labelled rows every text
scores 0; ids with more than one label teach the larger; repeated rows score alike.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm import textkit as tk
from skyloom.llm.language_id import split
from skyloom.llm.work import tidy

#: Labelled rows that teach the evidence, at most.
SAMPLE = 12_000
#: Confidence of the lower bounds of words and of beginnings, and the bound that a feature needs to be kept.
Z, Z_STEM, LEAST = 2.5, 3.2, 0.2
#: Texts of which a feature must be the strongest one, at least: what merely comes along with stronger evidence is none.
EXPLAINS = 1
#: Lengths in bytes of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)

# The letters that a character may imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "#": "aeiou", "v": "u",
}
SEPARATORS = " .-_*~'`,/\\"
#: Costs in nats: a disguise, a dropped separator, a dropped repetition.
SWAP, SKIP, AGAIN = 1.0, 0.3, 0.7
#: Characters between two looks at what all paths agree on, and the longest token whose reading a task remembers.
SETTLE, REMEMBER = 64, 64

#: Symbols of the character model: boundary, a to z, any other letter byte.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
N_SYMBOLS = 28

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_HIDING = np.zeros(256, bool)
_HIDING[[ord(c) for c in IMITATES if not c.isalpha()]] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in SEPARATORS if c != " "]] = True
#: What stands beside a word, what stands between words, and words as written.
_EDGE = SEPARATORS + "?;:()[]{}<>\"&"
_CUT = re.compile("[" + re.escape(SEPARATORS) + "]+")
_WRITTEN = re.compile(r"[0-9a-zA-Z\x80-\U0010ffff]+")


def _trigrams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: trigram counts over its texts."""
    total = np.zeros(N_SYMBOLS**3, np.int64)
    for batch in it:
        data, offsets = tk.text_buffer(batch.column("text"))
        for a, b in tk.slices(offsets):
            s = _SYMBOL[data[offsets[a] : offsets[b]]]
            s = np.insert(s, np.repeat(offsets[a : b + 1] - offsets[a], 2), 0)
            total += np.bincount((s[:-2] * N_SYMBOLS + s[1:-1]) * N_SYMBOLS + s[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


class CharModel:
    """Interpolated character trigrams: ``cost[x, y, z]`` is -ln P(z | x, y)."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape((N_SYMBOLS,) * 3).astype(float)
        one = (c.sum((0, 1)) + 0.5) / (c.sum() + 0.5 * N_SYMBOLS)
        two = (c.sum(0) + 5 * one) / (c.sum(0).sum(1, keepdims=True) + 5)
        three = (c + 5 * two[None]) / (c.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(three)).tolist()


def learn_characters(docs: DataFrame, text: str = "text") -> CharModel:
    """The driver gets ``N_SYMBOLS ** 3`` counts at most."""
    rows = docs.select(docs[text].alias("text")).mapInArrow(tidy(_trigrams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(N_SYMBOLS**3, np.int64)
    for gram, n in rows:
        counts[gram] = n
    return CharModel(counts)


def restore(token: str, model: CharModel, split: bool = False) -> str:
    """The likeliest letters behind a token: Viterbi over its lattice, states being the last two symbols.

    Separators are dropped; with ``split`` each may end a word instead, where that is likelier.
    What all paths agree on is set aside now and then, so that a long token costs its length.
    """
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    cost, settled = model.cost, []
    for i, ch in enumerate(token):
        sym = int(_SYMBOL[ord(ch)]) if ord(ch) < 128 else 27
        arcs: list[tuple[int, str, float]] = []
        if sym:
            arcs.append((sym, ch, 0.0))
        for to in IMITATES.get(ch, ""):
            arcs.append((ord(to) - 96, to, SWAP))
        skip = None
        if ch in SEPARATORS:
            skip = SKIP
            if split:
                arcs.append((0, " ", 0.0))
        elif i and ch == token[i - 1]:
            skip = AGAIN
        elif not arcs:
            skip = SKIP
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (x, y), (c, text) in best.items():
            if skip is not None and ((x, y) not in new or c + skip < new[x, y][0]):
                new[x, y] = (c + skip, text)
            row = cost[x][y]
            for s, to, extra in arcs:
                d = c + row[s] + extra
                if (y, s) not in new or d < new[y, s][0]:
                    new[y, s] = (d, text + to)
        best = new
        if i % SETTLE == SETTLE - 1:
            settled.append(os.path.commonprefix([text for _, text in best.values()]))
            best = {at: (c, text[len(settled[-1]) :]) for at, (c, text) in best.items()}
    return "".join(settled) + min(((c + cost[x][y][0], text) for (x, y), (c, text) in best.items()), default=(0.0, ""))[1]


def readings(token: str, model: CharModel) -> str:
    """All words behind a token that are not written in it: its separators dropped, or read as ends of words."""
    core = token.strip(_EDGE)
    tries = [core, core.strip("!*#+|")]
    if core[1:2] == " ":
        # One-letter words beside a word spaced apart.
        left = core[2:] if core[0] in "ai" else core
        right = core[:-2] if core[-1] in "ai" else core
        tries += [left, right, left[:-2] if core[-1] in "ai" else left]
    out: list[str] = []
    for t in dict.fromkeys(tries):
        if len(t) < 3:
            continue
        out.append(restore(t, model))
        pieces = _CUT.split(t)
        if len(pieces) > 1:
            out += restore(t, model, split=True).split()
            out += [restore(p, model) for p in pieces if len(p) > 2]
    written = set(_WRITTEN.findall(token))
    return " ".join(x for x in dict.fromkeys(out) if x not in written)


def hidden(data: np.ndarray, tokens: tk.Words) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, index of token) of every token of a slice that may hide a word, and the distinct tokens; ``tokens`` are cut at white space."""
    n, owner = len(data), tokens.owner()
    letter, hiding, apart = _LETTER[data], _HIDING[data], _APART[data]
    core = letter | hiding
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = core[:-1], core[1:]
    core &= ~((data == 33) & before)
    last = np.zeros(n, bool)
    last[tokens.ends - 1] = True
    twice = np.zeros(n, bool)
    twice[1:] = letter[1:] & (data[1:] == data[:-1])
    mark = (hiding & (after | (data != 33))) | (data == 118) | twice | (apart & before & ~last)
    count = lambda x: (lambda c: c[tokens.ends] - c[tokens.starts])(np.concatenate([[0], np.cumsum(x)]))
    letters = count(letter)
    # Without letters, symbols that are no digits must hide two at least.
    symbols = hiding & ~((data >= 48) & (data <= 57))
    differ = np.zeros(n, bool)
    differ[1:] = symbols[1:] & core[:-1] & (data[1:] != data[:-1])
    opened = (tokens.ends - tokens.starts > 2) & (count(mark) > 0) & ((letters > 0) | ((count(symbols) > 1) & (count(differ) > 0)))
    at = np.flatnonzero(opened)
    who, which, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
    if len(at):
        hashes = tk.spans_hash(tk._BYTE_VALUES[data], tk._BYTE_POWERS, tokens.starts[at], tokens.ends[at])
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.argsort(back, kind="stable")
        bound = np.concatenate([[0], np.cumsum(np.bincount(back))])
        for j, k in enumerate(at[first]):
            raw = data[tokens.starts[k] : tokens.ends[k]].tobytes()
            texts = np.unique(owner[at[order[bound[j] : bound[j + 1]]]])
            who.append(texts)
            which.append(np.full(len(texts), found.setdefault(raw.decode("utf-8", "replace"), len(found))))
    # Letters spaced apart: runs of tokens of one letter or disguise each, with separators beside or between them.
    if len(tokens.starts):
        cores = count(core)
        single = (cores <= 1) & (count(data >= 128) == 0) & (tokens.ends - tokens.starts <= 8)
        total = np.concatenate([[0], np.cumsum(cores)])
        new_text = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
        joins = single[1:] & single[:-1] & ~new_text[1:-1]
        begin = np.flatnonzero(single & ~np.concatenate([[False], joins]))
        end = np.flatnonzero(single & ~np.concatenate([joins, [False]])) + 1
        long = total[end] - total[begin] >= 3
        for a, b in zip(begin[long], end[long], strict=True):
            span = slice(tokens.starts[a], tokens.ends[b - 1])
            run = " ".join(data[span][core[span]].tobytes().decode("latin-1"))
            who.append(owner[a : a + 1])
            which.append(np.array([found.setdefault(run, len(found))]))
    return np.concatenate(who), np.concatenate(which), list(found)


def features(w: tk.Words) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each word and of its beginnings (0 where a word is not longer), and the text of each word."""
    size = w.ends - w.starts
    hashes = [w.hashes()]
    values = tk._BYTE_VALUES[w.data]
    for n in STEMS:
        stem = tk.mix(tk.spans_hash(values, tk._BYTE_POWERS, w.starts, np.minimum(w.starts + n, len(w.data))) ^ np.uint64(n))
        hashes.append(np.where(size > n, stem, np.uint64(0)))
    return hashes, w.owner()


def _restored_words(texts: list[str]) -> tk.Words:
    data, offsets = tk.text_buffer(pa.array(texts, pa.large_string()))
    return tk.Words(data, offsets, tk.NON_ALNUM, lower=True)


def _slice_features(data: np.ndarray, offsets: np.ndarray, model: CharModel, known: dict[str, str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of a slice, as written and as restored."""
    hashes, owner = features(tk.Words(data, offsets, tk.NON_ALNUM, lower=True))
    tokens = tk.Words(data, offsets, tk.WHITESPACE, lower=True)
    who, which, found = hidden(tokens.data, tokens)
    if found:
        if len(known) > 200_000:
            known.clear()
        words = []
        for token in found:
            got = known.get(token)
            if got is None:
                got = readings(token, model)
                if len(token) <= REMEMBER:
                    known[token] = got
            words.append(got)
        more, of = features(_restored_words(words))
        # Each text takes the words of its tokens.
        size = np.bincount(of, minlength=len(found))
        per = size[which]
        pick = np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        hashes = [np.concatenate([x, y[pick]]) for x, y in zip(hashes, more, strict=True)]
        owner = np.concatenate([owner, np.repeat(who, per)])
    return hashes, owner


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minimal hash of the five-word runs of each text (of its words, if it is shorter)."""
    for batch in it:
        out = []
        for _, _, w in tk.batches_of_words(batch, "text", separators=tk.NON_ALNUM, lower=True):
            least = np.zeros(len(w.counts), np.uint64)
            hashes, owner, _ = w.windows(5)
            for values, first in ((w.hashes(), w.first[:-1]), (hashes, np.searchsorted(owner, np.arange(len(w.counts))))):
                full = np.flatnonzero(np.diff(np.append(first, len(values))))
                if len(full):
                    least[full] = np.minimum.reduceat(values, first[full])
            out.append(least)
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(np.concatenate(out).view(np.int64))], names=["text", "toxic", "sign"])


def _evidence(model: CharModel):
    """Per task: in how many texts, and in how many toxic ones, each feature occurs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in it:
            toxic = batch.column("toxic").to_numpy()
            data, offsets = tk.text_buffer(batch.column("text"))
            for a, b in tk.slices(offsets):
                (word, *stems), owner = _slice_features(data[offsets[a] : offsets[b]], offsets[a : b + 1], model, known)
                order = np.lexsort((owner, word))
                word, owner = word[order], owner[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
                order, word, bad = order[new], word[new], toxic[a:b][owner[new]]
                at = tk.runs(word)
                if len(at):
                    n = np.diff(np.append(at, len(word)))
                    cols = [word[at], *(x[order[at]] for x in stems)]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x.view(np.int64)) for x in cols), pa.array(n), pa.array(np.add.reduceat(bad, at).astype(np.int64))],
                        names=["word", *(f"stem{x}" for x in STEMS), "n", "bad"],
                    )

    return run


def learn_evidence(docs: DataFrame, labels: DataFrame, model: CharModel, sample: int = SAMPLE, text: str = "text", toxic: str = "toxic", id: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes in order, their lower bounds), learned from at most ``sample`` labelled ids.

    Ids are drawn from the labels alone, so only the drawn texts move; the drawn ids are few enough to broadcast.
    """
    known = labels.select(labels[id].alias("id"), labels[toxic].cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("id"))
    last = known.orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    chosen = known.where(F.lit(False) if last is None else F.col("draw") <= last).select("id", "toxic")
    drawn = docs.select(docs[id].alias("id"), docs[text].alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic")
    once = drawn.mapInArrow(tidy(_signatures), "text string, toxic int, sign long").groupBy("sign", "toxic").agg(F.min("text").alias("text"))
    stems = [f"stem{x}" for x in STEMS]
    schema = "word long, " + ", ".join(f"{x} long" for x in stems) + ", n long, bad long"
    counts = once.select("text", "toxic").mapInArrow(tidy(_evidence(model)), schema).groupBy("word", *stems).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    words = counts.select(F.col("word").alias("feature"), "n", F.col("bad").cast("double").alias("bad"), F.lit(Z).alias("z"))
    # A beginning is judged by its words, each one observation: a single word says nothing about others like it.
    each = counts.select(F.explode(F.array(*stems)).alias("feature"), (F.col("bad") / F.col("n")).alias("bad")).where("feature <> 0")
    begun = each.groupBy("feature").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumn("z", F.lit(Z_STEM))
    total = words.union(begun).where("bad > 1")
    n, z = F.col("n"), F.col("z")
    p = F.col("bad") / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    kept = sorted(total.select("feature", low.alias("low")).where(F.col("low") >= LEAST).collect())
    hashes = np.array([r["feature"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    found = hashes[order], np.array([r["low"] for r in kept], float)[order]
    best = once.where("toxic = 1").select("text").mapInArrow(tidy(_strongest(model, found)), "feature long").groupBy("feature").count().where(F.col("count") >= EXPLAINS)
    needed = np.isin(found[0], np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))
    return found[0][needed], found[1][needed]


def _strongest(model: CharModel, evidence: tuple[np.ndarray, np.ndarray]):
    """The strongest features of each text, once per text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in it:
            data, offsets = tk.text_buffer(batch.column("text"))
            for a, b in tk.slices(offsets):
                every, owner = _slice_features(data[offsets[a] : offsets[b]], offsets[a : b + 1], model, known)
                top = np.zeros(b - a)
                hits = [(owner[hit], np.searchsorted(evidence[0], found[hit])) for found in every for hit in [tk.member(found, evidence[0])]]
                which, at = (np.concatenate(x) for x in zip(*hits, strict=True))
                if len(which):
                    np.maximum.at(top, which, evidence[1][at])
                    good = evidence[1][at] >= top[which]
                    pair = np.unique(np.stack([which[good], at[good]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(evidence[0][pair[1]].view(np.int64))], names=["feature"])

    return run


def score(docs: DataFrame, model: CharModel, evidence: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """(rest: struct of all columns but the text, text, score) for each row."""
    hashes, low = evidence

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in it:
            out = []
            data, offsets = tk.text_buffer(batch.column("text"))
            for a, b in tk.slices(offsets):
                got = np.zeros(b - a)
                every, owner = _slice_features(data[offsets[a] : offsets[b]], offsets[a : b + 1], model, known)
                for found in every:
                    hit = tk.member(found, hashes)
                    if hit.any():
                        np.maximum.at(got, owner[hit], low[np.searchsorted(hashes, found[hit])])
                out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("text"), pa.array(np.concatenate([np.zeros(0), *out]))], names=["rest", "text", "score"])

    others = [docs[c] for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    base = docs.select(F.struct(*others).alias("rest"), docs[text].alias("text"))
    return base.mapInArrow(tidy(run), T.StructType([*base.schema, T.StructField("score", T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[CharModel, tuple[np.ndarray, np.ndarray]]:
    """Character model and evidence from the training rows: checksum of doc_id not 0 modulo 5."""
    teaches = ~split(F.col("doc_id"), 5, 0)
    train = docs.select("doc_id", "text").where(teaches)
    model = learn_characters(train)
    return model, learn_evidence(train, labels.where(teaches), model)


def drop_toxic(docs: DataFrame, fitted: tuple[CharModel, tuple[np.ndarray, np.ndarray]], text: str = "text") -> DataFrame:
    """``docs`` without the texts that score 0.5 or more."""
    found = score(docs, *fitted, text=text).where("score < 0.5")
    return found.select([F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns])


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fitted = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, *fitted)
    id = F.col("rest.doc_id")
    return found.select(id.alias("doc_id"), split(id, 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
