"""Katz backoff language model over words, fitted and evaluated in Spark.

Counts (``fit``). Words are 62-bit hashes; frequent ones, the head (``1 / 2**HEAD_BITS``
of all tokens or more, so ``2**HEAD_BITS`` at most), are coded by rank and broadcast.
Bigrams are counted by block of input, then by bucket. A bigram whose word is not in
the head belongs to its word's bucket, else to its history's if that is not in the
head, else to its own: so no bucket holds more of a frequent word than of others,
and the count of a rare word is known where its bigrams are. Pairs of very frequent
words (``1 / 2**HOT_BITS`` of all tokens) are counted in one small matrix.

Model. Counts up to ``CUTOFF`` are discounted after Good-Turing, larger ones by
``TRIM``, so that every history has mass left. A seen bigram has d(c) c / c(h). An unseen
one has alpha(h) P(w), where alpha(h) is what the seen bigrams leave over what their
words leave of the unigrams, so that all words and the unknown one sum to 1 exactly.
Unigrams are discounted alike; what they leave is the unknown word's. ``pairs`` and
``backoff`` are tables of one packed row per bucket.

Evaluation (``score``). Each token is looked up in its bigram's bucket. A seen one ends
there. An unseen one recurses: to its unigram, in the same bucket, and to its
history's alpha, in the history's bucket. The share of 1 / c(h) is added where the
history itself is a word, and taken back with alpha if the bigram is unseen.

Cases: a null or empty text is its end alone; without training texts every token is
unknown; repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textkit as tk
from skyloom.llm.language_id import split
from skyloom.llm.work import exchange, pack, partitions, stored, tidy, unpack

HEAD_BITS, HOT_BITS = 18, 10
CUTOFF, TRIM = 5, 0.01
BLOCK_WORDS = 600_000

START, END, FIRST = 0, 1, 2
_RARE = 1 << 62
_PACKED = "kind string, bucket int, payload binary"


def discounts(n_r: list[int]) -> list[float]:
    """What a count of 1..CUTOFF keeps of itself, given how many types have counts 1..CUTOFF + 1.

    Good-Turing after Katz; where too few types make that no discount, absolute discounting.
    """
    k, n = CUTOFF, [0, *n_r]
    d = []
    if all(n[r] > 0 for r in range(1, k + 2)):
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
    if not d or not all(0 < x < 1 for x in d):
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [(r - off) / r for r in range(1, k + 1)]
    return d


def kept(c: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) * c for an array of counts."""
    small = np.array([0.0, *(x * r for r, x in enumerate(d, 1))])
    return np.where(c <= CUTOFF, small[np.minimum(c, CUTOFF)], c - TRIM)


@dataclass
class Model:
    """What every task needs; ``pairs`` and ``backoff`` stay in their tables."""

    words: np.ndarray  # hashes of head words in order; code = place + FIRST
    counts: np.ndarray  # by code
    tokens: int
    types: int
    unigram: list[float]
    unknown: float
    bigram: list[float]
    hot: np.ndarray  # by code: row in the matrix, or -1
    matrix: np.ndarray

    def log_word(self, c: np.ndarray) -> np.ndarray:
        """log10 P(w) of words with these counts."""
        with np.errstate(divide="ignore"):
            return np.where(c > 0, np.log10(kept(c, self.unigram) / max(self.tokens, 1)), np.log10(self.unknown))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _stream(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, history, text) of every token of a slice, ends included."""
    word = (w.hashes() >> np.uint64(2)).astype(np.int64) | _RARE
    word = np.insert(word, w.first[1:], END)
    n = w.counts + 1
    history = np.concatenate([[START], word[:-1]])
    history[np.cumsum(n) - n] = START
    return word, history, np.repeat(np.arange(len(n)), n)


def _coded(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Head words by rank, others as they are."""
    if len(words) == 0:
        return x
    at = np.searchsorted(words, x)
    at[at == len(words)] = 0
    return np.where(words[at] == x, at + FIRST, x)


def _shrink(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rare = codes >= _RARE
    return np.where(rare, -1, codes).astype(np.int32), codes[rare]


def _grow(small: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[out < 0] = rare
    return out


def _hash_bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(x.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _pair_bucket(word: np.ndarray, history: np.ndarray, n: int) -> np.ndarray:
    both = (tk.mix(history.view(np.uint64)) ^ word.view(np.uint64)).view(np.int64)
    return _hash_bucket(np.where(word >= _RARE, word, np.where(history >= _RARE, history, both)), n)


def _rows(rows: list[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("payload", pa.binary())])
    for i in range(0, len(rows), 400):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 400], strict=True), schema.types, strict=True)], schema=schema)


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in it:
        for kind, bucket, payload in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
            yield kind, bucket, payload.as_py()


# ------------------------------------------------------------------ fitting


def _count_words(n: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        word = np.sort(np.concatenate(held))
        at = tk.runs(word)
        count = np.diff(np.append(at, len(word)))
        word = word[at]
        order, bound = tk.split_by(_hash_bucket(word, n), n)
        own = [order[bound[k] : bound[k + 1]] for k in range(n)]
        yield from _rows([("word", k, pack(word[x], count[x].astype(np.int32))) for k, x in enumerate(own) if len(x)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            for _, _, w in tk.batches_of_words(batch, "text", lower=True):
                held.append(_stream(w)[0])
                size += len(held[-1])
                if size >= BLOCK_WORDS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _merge_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [unpack(x) for _, _, x in _read(it)]
    if got:
        word, count = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(word)
        word, count = word[order], count[order].astype(np.int64)
        at = tk.runs(word)
        yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(np.add.reduceat(count, at))], names=["word", "n"])


def _hot_pairs(words: np.ndarray, hot: np.ndarray):
    """Per task: counts of pairs of hot words, as cells of the matrix."""
    size = int(hot.max()) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in it:
            for _, _, w in tk.batches_of_words(batch, "text", lower=True):
                word, history, _ = _stream(w)
                a, b = _rank(_coded(history, words), hot), _rank(_coded(word, words), hot)
                both = (a >= 0) & (b >= 0)
                total += np.bincount(a[both] * size + b[both], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def _rank(codes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.where(codes < len(hot), hot[np.minimum(codes, len(hot) - 1)], -1)


def _sorted_pairs(word: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, int]:
    """An order with the pairs of rare words first, by word, then the rest, by history; and how many come first."""
    rare = word >= _RARE
    order = np.lexsort((np.where(rare, history, word), np.where(rare, word, history), ~rare))
    return order, int(rare.sum())


def _by_bucket(word: np.ndarray, history: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, int]]:
    order, bound = tk.split_by(_pair_bucket(word, history, n), n)
    for k in range(n):
        own = order[bound[k] : bound[k + 1]]
        if len(own):
            inner, rare = _sorted_pairs(word[own], history[own])
            yield k, own[inner], rare


def _count_pairs(words: np.ndarray, hot: np.ndarray, n: int):
    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        word, history = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = []
        for k, own, _ in _by_bucket(word, history, n):
            w, h = word[own], history[own]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(new)
            rows.append(("count", k, pack(*_shrink(w[at]), *_shrink(h[at]), np.diff(np.append(at, len(w))).astype(np.int32))))
        yield from _rows(rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            for _, _, w in tk.batches_of_words(batch, "text", lower=True):
                word, history, _ = _stream(w)
                word, history = _coded(word, words), _coded(history, words)
                cold = (_rank(word, hot) < 0) | (_rank(history, hot) < 0)
                held.append((word[cold], history[cold]))
                size += len(held[-1][0])
                if size >= BLOCK_WORDS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _merge_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs table's row of a bucket, and how many of its pairs have counts 1, 2, ..."""
    parts, bucket = [], 0
    for _, bucket, payload in _read(it):
        ws, wr, hs, hr, c = unpack(payload)
        parts.append((_grow(ws, wr), _grow(hs, hr), c))
    if not parts:
        return
    word, history, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, _ = _sorted_pairs(word, history)
    word, history, count = word[order], history[order], count[order].astype(np.int64)
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (history[1:] != history[:-1])
    at = np.flatnonzero(new)
    count = np.add.reduceat(count, at)
    of = np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
    yield pa.RecordBatch.from_arrays(
        [pa.array(["pairs"]), pa.array([bucket], pa.int32()), pa.array([pack(*_shrink(word[at]), *_shrink(history[at]), count)], pa.binary()), pa.array([of.tolist()], pa.list_(pa.int64()))],
        names=["kind", "bucket", "payload", "n_r"],
    )


def _pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ws, wr, hs, hr, count = unpack(payload)
    return _grow(ws, wr), _grow(hs, hr), count


def _word_counts(word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rare words of a bucket and their counts: all of a rare word's bigrams are in its bucket."""
    rare = int(np.searchsorted(-(word >= _RARE).astype(np.int8), 0))
    if rare == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = tk.runs(word[:rare])
    return word[:rare][at], np.add.reduceat(count[:rare], at)


def _count_of(x: np.ndarray, each: np.ndarray, count: np.ndarray) -> np.ndarray:
    if len(each) == 0:
        return np.zeros(len(x), np.int64)
    at = np.searchsorted(each, x)
    at[at == len(each)] = 0
    return np.where(each[at] == x, count[at], 0)


def _counts(word: np.ndarray, m: Model, rare: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    head = word < _RARE
    return np.where(head, m.counts[np.where(head, word, 0)], _count_of(word, *rare))


def _histories(history: np.ndarray, c: np.ndarray, mass: np.ndarray, words: np.ndarray, n: int) -> list[tuple[str, int, bytes]]:
    """Sums by history, packed for the histories' buckets."""
    order = np.argsort(history, kind="stable")
    h = history[order]
    at = tk.runs(h)
    if not len(at):
        return []
    c, mass, words = (np.add.reduceat(x[order], at) for x in (c, mass, words))
    h = h[at]
    order, bound = tk.split_by(_hash_bucket(h, n), n)
    own = [order[bound[k] : bound[k + 1]] for k in range(n)]
    return [("history", k, pack(*_shrink(h[x]), c[x].astype(np.int64), mass[x], words[x])) for k, x in enumerate(own) if len(x)]


def _spread(m: Model, n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, payload in _read(it):
            word, history, c = _pairs(payload)
            p = 10 ** m.log_word(_counts(word, m, _word_counts(word, c)))
            yield from _rows(_histories(history, c, kept(c, m.bigram), p, n))

    return run


def _back_off(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The backoff table's row of a bucket: log10 of alpha(h) c(h) by history."""
    parts, bucket = [], 0
    for _, bucket, payload in _read(it):
        hs, hr, *rest = unpack(payload)
        parts.append((_grow(hs, hr), *rest))
    if not parts:
        return
    h, c, mass, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = tk.runs(h)
    c, mass, words = (np.add.reduceat(x[order], at) for x in (c, mass, words))
    value = np.log10(c - mass) - np.log10(np.maximum(1 - words, 1e-300))
    yield from _rows([("backoff", bucket, pack(*_shrink(h[at]), value))])


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The model of a frame's texts: what tasks need, the pairs table and the backoff table."""
    spark = docs.sparkSession
    n = partitions(spark)
    base = docs.select(docs[text].alias("text"))
    unigrams = stored(exchange(base.mapInArrow(tidy(_count_words(n)), _PACKED)).mapInArrow(tidy(_merge_words), "word long, n long"), "unigrams")
    sums = [F.sum((F.col("n") == r).cast("long")).alias(f"n{r}") for r in range(1, CUTOFF + 2)]
    kept_small = [F.coalesce(x, F.lit(0)) for x in sums]
    row = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0)), F.sum((F.col("n") > CUTOFF).cast("long")), *kept_small).first()
    tokens, types, texts, large, n_r = row[0], row[1], row[2], row[3] or 0, list(row[4:])
    # At most 2 ** HEAD_BITS words can be this frequent.
    head = sorted(unigrams.where((F.col("n") * (1 << HEAD_BITS) >= tokens) & (F.col("word") != END)).collect())
    words = np.array([r[0] for r in head], np.int64)
    counts = np.array([texts, texts, *(r[1] for r in head)], np.int64)
    d = discounts(n_r)
    left = sum((1 - x) * r * n_r[r - 1] for r, x in enumerate(d, 1)) + TRIM * large
    hot = np.full(len(counts), -1, np.int64)
    frequent = np.flatnonzero((counts << HOT_BITS >= tokens) | (np.arange(len(counts)) < FIRST))
    hot[frequent] = np.arange(len(frequent))
    matrix = np.zeros((len(frequent),) * 2, np.int64)
    for cell, c in base.mapInArrow(tidy(_hot_pairs(words, hot)), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        matrix.flat[cell] = c
    counted = exchange(base.mapInArrow(tidy(_count_pairs(words, hot, n)), _PACKED)).mapInArrow(tidy(_merge_pairs), _PACKED + ", n_r array<long>")
    pairs = stored(counted, "pairs")
    found = pairs.agg(*[F.coalesce(F.sum(F.col("n_r")[r]), F.lit(0)) for r in range(CUTOFF + 1)]).first()
    of = np.bincount(np.minimum(matrix.ravel(), CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
    m = Model(words, counts, tokens, types, d, left / tokens if tokens else 1.0, discounts([int(a + b) for a, b in zip(found, of, strict=True)]), hot, matrix)
    a, b = np.nonzero(matrix)
    c = matrix[a, b]
    dense = _histories(frequent[a], c, kept(c, m.bigram), 10 ** m.log_word(counts[frequent[b]]), n)
    pairs = pairs.drop("n_r")
    spread = pairs.mapInArrow(tidy(_spread(m, n)), _PACKED).union(spark.createDataFrame([(k, x, bytearray(y)) for k, x, y in dense], _PACKED))
    backoff = stored(exchange(spread).mapInArrow(tidy(_back_off), _PACKED), "backoff")
    return m, pairs, backoff


# --------------------------------------------------------------- evaluation


def _sums(rid: np.ndarray, base: np.ndarray, known: np.ndarray, score: np.ndarray, n: int) -> list[tuple[str, int, bytes]]:
    """Shares of texts' scores, packed for the texts' buckets; rows come in order of rid."""
    order, bound = tk.split_by(_hash_bucket(rid, n), n)
    own = [order[bound[k] : bound[k + 1]] for k in range(n)]
    return [("share", k, pack(np.diff(rid[x], prepend=0), base[x], known[x].astype(np.int32), score[x])) for k, x in enumerate(own) if len(x)]


def _ask(m: Model, n: int):
    """Per block of texts: what the head settles, and the tokens that must be looked up, by bucket."""

    def flush(held: list[tuple], texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        word, history, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        rid, id, valid = (np.concatenate(x) for x in zip(*texts, strict=True))
        size = len(rid)
        per = lambda x, at=slice(None): np.bincount(doc[at], weights=x, minlength=size)
        head = word < _RARE
        c = m.counts[np.where(head, word, 0)]
        base = per(np.where(head, m.log_base(c), 0.0))
        known = per(head & (c > 0))
        n_tokens = per(np.ones(len(word)))
        # The history's share; that of a rare history is added where it is a word.
        past = m.counts[np.where(history < _RARE, history, 0)]
        score = -per(np.where(history < _RARE, np.log10(np.maximum(past, 1)), 0.0))
        a, b = _rank(history, m.hot), _rank(word, m.hot)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        seen = m.matrix[a[both], b[both]]
        score += per(np.where(seen > 0, np.log10(np.maximum(kept(seen, m.bigram), 1e-300)), m.log_word(c[both])), both)
        rows = []
        order, bound = tk.split_by(_hash_bucket(rid, n), n)
        for k in range(n):
            x = order[bound[k] : bound[k + 1]]
            if len(x):
                rows.append(("text", k, pack(np.diff(rid[x], prepend=0), id[x], valid[x], n_tokens[x].astype(np.int64), base[x], known[x].astype(np.int32), score[x])))
        unseen = both[seen == 0]
        rows += _open(history[unseen], rid[doc[unseen]], n)
        cold = np.ones(len(word), bool)
        cold[both] = False
        cold = np.flatnonzero(cold)
        word, history, doc = word[cold], history[cold], doc[cold]
        for k, own, _ in _by_bucket(word, history, n):
            here, index = np.unique(doc[own], return_inverse=True)
            rows.append(("token", k, pack(*_shrink(word[own]), *_shrink(history[own]), index.astype(np.uint16 if len(here) <= 1 << 16 else np.int32), np.diff(rid[here], prepend=0))))
        yield from _rows(rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size, docs = [], [], 0, 0
        for batch in it:
            rid, id = batch.column("rid").to_numpy(), batch.column("id")
            valid = id.is_valid().to_numpy(zero_copy_only=False)
            id = id.fill_null(0).to_numpy()
            for x, y, w in tk.batches_of_words(batch, "text", lower=True):
                word, history, doc = _stream(w)
                held.append((_coded(word, m.words), _coded(history, m.words), doc + docs))
                texts.append((rid[x:y], id[x:y], valid[x:y]))
                size, docs = size + len(word), docs + y - x
                if size >= BLOCK_WORDS:
                    yield from flush(held, texts)
                    held, texts, size, docs = [], [], 0, 0
        if held:
            yield from flush(held, texts)

    return run


def _open(history: np.ndarray, rid: np.ndarray, n: int) -> list[tuple[str, int, bytes]]:
    """Unseen bigrams, packed for the buckets of their histories."""
    order = np.lexsort((rid, history))
    history, rid = history[order], rid[order]
    by, bound = tk.split_by(_hash_bucket(history, n), n)
    own = [by[bound[k] : bound[k + 1]] for k in range(n)]
    return [("open", k, pack(*_shrink(history[x]), np.diff(rid[x], prepend=0))) for k, x in enumerate(own) if len(x)]


def _look_up(m: Model, n: int):
    """A bucket's tokens against its row of the pairs table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = (np.zeros(0, np.int64),) * 3
        asked = []
        for kind, bucket, payload in _read(it):
            if kind == "pairs":
                table = _pairs(payload)
            elif kind == "token":
                asked.append(payload)
            else:
                yield from _rows([(kind, bucket, payload)])
        if not asked:
            return
        word_, history_, count_ = table
        rare_words = _word_counts(word_, count_)
        parts, rids = [], []
        base_at = 0
        for payload in asked:
            ws, wr, hs, hr, index, steps = unpack(payload)
            parts.append((_grow(ws, wr), _grow(hs, hr), index.astype(np.int64) + base_at))
            rids.append(np.cumsum(steps))
            base_at += len(steps)
        del asked
        word, history, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        rid = np.concatenate(rids)
        del parts
        # Equal pairs side by side, the table's entry first.
        all_word, all_history = np.concatenate([word_, word]), np.concatenate([history_, history])
        order = np.lexsort((all_history, all_word))
        w, h = all_word[order], all_history[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (h[1:] != h[:-1])
        del w, h, all_word, all_history
        group = np.cumsum(new) - 1
        each = np.zeros(int(group[-1]) + 1, np.int64)
        from_table = order < len(word_)
        each[group[from_table]] = count_[order[from_table]]
        c = np.empty(len(word), np.int64)
        c[order[~from_table] - len(word_)] = each[group[~from_table]]
        del order, group, from_table
        own = _counts(word, m, rare_words)
        rare = word >= _RARE
        score = np.where(c > 0, np.log10(np.maximum(kept(c, m.bigram), 1e-300)), m.log_word(own))
        # A rare word is the history of the next token; the share of frequent ones is settled.
        score -= np.where(rare, np.log10(np.maximum(own, 1)), 0.0)
        base = np.where(rare, m.log_base(own), 0.0)
        sums = [np.bincount(doc, weights=x, minlength=len(rid)) for x in (base, rare & (own > 0), score)]
        order = np.argsort(rid, kind="stable")
        at = tk.runs(rid[order])
        yield from _rows(_sums(rid[order][at], *(np.add.reduceat(x[order], at) for x in sums), n))
        unseen = np.flatnonzero(c == 0)
        yield from _rows(_open(history[unseen], rid[doc[unseen]], n))

    return run


def _settle(n: int):
    """Unseen bigrams against the backoff table: their histories' shares by text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, value, asked = np.zeros(0, np.int64), np.zeros(0), []
        for kind, _, payload in _read(it):
            hs, hr, rest = unpack(payload)
            if kind == "backoff":
                each, value = _grow(hs, hr), rest
            else:
                asked.append((_grow(hs, hr), np.cumsum(rest)))
        if asked:
            history, rid = (np.concatenate(x) for x in zip(*asked, strict=True))
            share = np.zeros(len(history))
            if len(each):
                at = np.searchsorted(each, history)
                at[at == len(each)] = 0
                share = np.where(each[at] == history, value[at], 0.0)
            order = np.argsort(rid, kind="stable")
            rid, share = rid[order], share[order]
            at = tk.runs(rid)
            zero = np.zeros(len(at))
            yield from _rows(_sums(rid[at], zero, zero, np.add.reduceat(share, at), n))

    return run


def _total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, shares = [], []
    for kind, _, payload in _read(it):
        steps, *rest = unpack(payload)
        (texts if kind == "text" else shares).append((np.cumsum(steps), *rest))
    if not texts:
        return
    rid, id, valid, n_tokens, base, known, score = (np.concatenate(x) for x in zip(*texts, strict=True))
    order = np.argsort(rid)
    rid, id, valid, n_tokens, base, known, score = (x[order] for x in (rid, id, valid, n_tokens, base, known.astype(np.int64), score))
    for r, b, k, s in shares:
        at = np.searchsorted(rid, r)
        base[at] += b
        known[at] += k
        score[at] += s
    yield pa.RecordBatch.from_arrays(
        [pa.array(id, mask=~valid), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "base_score", "score"]
    )


def score(docs: DataFrame, fitted: tuple[Model, DataFrame, DataFrame], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row: log10 probabilities of its text."""
    m, pairs, backoff = fitted
    n = partitions(docs.sparkSession)
    base = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).withColumn("rid", F.monotonically_increasing_id())
    asked = base.mapInArrow(tidy(_ask(m, n)), _PACKED).union(pairs)
    answers = stored(exchange(asked).mapInArrow(tidy(_look_up(m, n)), _PACKED), "answers")
    unseen = answers.where("kind = 'open'").union(backoff)
    settled = exchange(unseen).mapInArrow(tidy(_settle(n)), _PACKED)
    shares = answers.where("kind <> 'open'").union(settled)
    return exchange(shares).mapInArrow(tidy(_total), "id long, n_tokens long, n_known long, base_score double, score double")


def op1_katz(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fitted = fit(docs.where(~split(F.col("doc_id"), 5, 1)))
    found = score(docs, fitted)
    return found.select(
        F.col("id").alias("doc_id"),
        split(F.col("id"), 5, 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(fitted[0].tokens)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
