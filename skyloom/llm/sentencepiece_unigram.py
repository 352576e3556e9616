"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets a space in front; spaces are the pieces' marker (U+2581). No piece holds
a marker behind another character, so a text falls into chunks, spaces and the rest
up to the next space, that are segmented on their own, each distinct chunk once
while a task remembers it. All chunks advance together: one numpy step matches one more byte at
every start, or relaxes the paths from one more position.

Scores are log probabilities. A unigram file has them. A BPE file has merge ranks
(0, -1, -2, ...) in their place, whose sums mean nothing, so ``load`` turns rank r
into the log of Zipf's law, 1 / (r + ``ZIPF``) over the sum of all: earlier merges
are more frequent pieces. Tokenizers are not trained here.

A character that no piece covers costs ``UNKNOWN`` below the lowest score and becomes
its bytes' pieces. Of equally good paths the one whose last piece is longest stays.
Decoding joins the pieces' bytes and drops the first space, so it returns every text exactly.

Cases: a null text is empty and has no pieces; a marker in a text itself becomes
bytes and comes back as it was; repeated rows are encoded alike; a very long text is a
slice of its own, whose chunks are still segmented one by one; other columns are not
read; an empty table has no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textkit as tk

MARKER = "▁"
UNKNOWN = 10.0
#: Mandelbrot's shift of Zipf's law, for files that have ranks.
ZIPF = 2.7


class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        root: dict = {}
        for key, value in zip(keys, values, strict=True):
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        # Nodes with several children look from ``wide`` on, which skips ranges found crowded; others fill the gaps from ``free``.
        free, wide, todo = 257, 1, deque([(0, root)])
        while todo:
            state, node = todo.popleft()
            value[state] = node.pop(-1, -1)
            if not node:
                continue
            codes = sorted(node)
            while len(codes) == 1 and free < len(check) and check[free] != -1:
                free += 1
            b = first = free - codes[0] if len(codes) == 1 else wide
            while True:
                while b + 256 >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[b + c] == -1 for c in codes):
                    break
                b += 1
            if len(codes) > 1 and b - first > 16:
                wide = b
            base[state] = b
            for c in codes:
                check[b + c] = state
            for c in codes:
                todo.append((b + c, node[c]))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Vocabulary:
    """Pieces with log probabilities; ``bytes_`` are the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_: list[int], skip: set[int] | None = None):
        skip = (skip or set()) | set(bytes_)
        use = [i for i in range(len(pieces)) if i not in skip and pieces[i]]
        if any(MARKER in pieces[i].lstrip(MARKER) for i in use):
            raise ValueError("a piece holds a marker behind another character")
        keys = [pieces[i].replace(MARKER, " ").encode() for i in use]
        self.trie = DoubleArray(keys, use)
        self.longest = max(map(len, keys), default=0)
        self.scores = np.array(scores, float)
        self.unknown = min((scores[i] for i in use), default=0.0) - UNKNOWN
        self.bytes = np.array(bytes_, np.int64)
        self.surface = [p.replace(MARKER, " ").encode() for p in pieces]
        for b, i in enumerate(bytes_):
            self.surface[i] = bytes([b])
        for i in (skip or set()) - set(bytes_):
            self.surface[i] = b""


def log_scores(scores: list[float], use: list[int]) -> list[float]:
    """Log probabilities of the pieces of a file that is not a unigram model: by Zipf's law from merge ranks (whole numbers), else the scores as they are."""
    own = np.array([scores[i] for i in use], float)
    if not len(own) or (own != np.round(own)).any() or (own == own[0]).all():
        return list(scores)
    rank = np.empty(len(own))
    rank[np.argsort(-own, kind="stable")] = np.arange(len(own))
    out = np.array(scores, float)
    out[use] = -np.log(rank + ZIPF) - np.log((1 / (rank + ZIPF)).sum())
    return out.tolist()


def is_unigram(model: bytes) -> bool:
    """Whether a model file says that its scores are log probabilities of a unigram model, whatever numbers they are."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    kind = proto.ModelProto.FromString(model).trainer_spec.model_type
    return kind == proto.TrainerSpec.UNIGRAM


@cache
def load(path: str) -> Vocabulary:
    """A vocabulary file with byte fallback; read on the driver alone."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)}
    bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(not sp.is_byte(i) for i in bytes_):
        raise ValueError(f"{path} has no byte pieces")
    use = [i for i in range(n) if i not in special and not sp.is_byte(i)]
    scores = [sp.get_score(i) for i in range(n)]
    return Vocabulary(pieces, scores if is_unigram(sp.serialized_model_proto()) else log_scores(scores, use), bytes_, special)


def _matches(v: Vocabulary, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id) of every piece in chunks laid end to end; ``limit`` is where a position's chunk ends."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.ones(len(data), np.int64)
    width[data >= 0xC0] = 2
    width[data >= 0xE0] = 3
    width[data >= 0xF0] = 4
    covered = np.zeros(len(data), bool)
    state = np.zeros(len(begin), np.int64)
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    at, found = begin, []
    for step in range(v.longest):
        state, at = state[at + step < limit[at]], at[at + step < limit[at]]
        to = base[state] + data[at + step]
        good = (check[to] == state) & (base[state] > 0)
        state, at = to[good].astype(np.int64), at[good]
        if not len(at):
            break
        id = value[state]
        hit = id >= 0
        found.append((at[hit], np.full(hit.sum(), step + 1), id[hit].astype(np.int64)))
        one = at[hit & (width[at] == step + 1)]
        covered[one] = True
    bare = begin[~covered[begin]]
    found.append((bare, width[bare], np.full(len(bare), -1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def segment(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of the best segmentation of chunks: ``bounds[i]`` to ``bounds[i + 1]`` are chunk i's ids."""
    size = np.diff(offsets)
    n = len(size)
    chunk = np.repeat(np.arange(n), size)
    start, length, id = _matches(v, data, offsets[1:][chunk])
    score = np.where(id >= 0, v.scores[id], v.unknown)
    own = chunk[start]
    depth = start - offsets[own]
    # Position p of chunk i is node start + i, as every chunk has one node more than bytes.
    node = start + own
    order = np.argsort(depth, kind="stable")
    start, length, id, score, node = (x[order] for x in (start, length, id, score, node))
    cut = np.concatenate([[0], np.cumsum(np.bincount(depth))]) if len(depth) else np.zeros(1, np.int64)
    best = np.full(len(data) + n, -np.inf)
    best[offsets[:-1] + np.arange(n)] = 0.0
    via = np.full(len(data) + n, -1)
    for a, b in zip(cut, cut[1:], strict=False):
        reach = best[node[a:b]] + score[a:b]
        to = node[a:b] + length[a:b]
        better = reach > best[to]
        best[to[better]] = reach[better]
        via[to[better]] = np.arange(a, b)[better]
    at = offsets[1:] + np.arange(n)
    live = np.flatnonzero(size > 0)
    taken = []
    while len(live):
        m = via[at[live]]
        taken.append((live, m))
        at[live] -= length[m]
        live = live[at[live] > offsets[live] + live]
    if not taken:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    which, m = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.argsort(start[m], kind="stable")
    m, which = m[order], which[order]
    times = np.where(id[m] >= 0, 1, length[m])
    first = np.repeat(np.cumsum(times) - times, times)
    ids = np.repeat(id[m], times)
    raw = np.repeat(start[m], times) + np.arange(len(ids)) - first
    ids = np.where(ids >= 0, ids, v.bytes[data[raw]])
    return ids, np.concatenate([[0], np.cumsum(np.bincount(np.repeat(which, times), minlength=n))])


class Known:
    """Chunks that a task has segmented, by hash; it starts anew beyond ``LIMIT`` chunks."""

    LIMIT = 400_000

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.start = self.count = self.ids = np.zeros(0, np.int64)

    def look_up(self, v: Vocabulary, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` the pieces of distinct chunks (hashes in order) start, and how many they are."""
        if len(self.hashes) + len(hashes) > self.LIMIT:
            self.__init__()
        new = np.flatnonzero(~tk.member(hashes, self.hashes))
        if len(new):
            length = (end - begin)[new]
            chunks = np.concatenate([[0], np.cumsum(length)])
            ids, bounds = segment(v, data[np.repeat(begin[new] - chunks[:-1], length) + np.arange(chunks[-1])], chunks)
            order = np.argsort(both := np.concatenate([self.hashes, hashes[new]]), kind="stable")
            self.hashes = both[order]
            self.start = np.concatenate([self.start, bounds[:-1] + len(self.ids)])[order]
            self.count = np.concatenate([self.count, np.diff(bounds)])[order]
            self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, hashes)
        return self.start[at], self.count[at]


def encode_slice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of the texts that lie end to end in data."""
    known = known or Known()
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    full = size > 0
    # A space in front of every text that has any characters.
    data = np.insert(data, offsets[:-1][full], 32)
    offsets = np.concatenate([[0], np.cumsum(size + full)])
    space = data == 32
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    cut[offsets] = True
    bound = np.flatnonzero(cut)
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
    begin, end = bound[:-1], bound[1:]
    hashes = tk.spans_hash(tk._BYTE_VALUES[data], tk._BYTE_POWERS, begin, end)
    order = np.argsort(hashes)
    lead = tk.runs(hashes[order])
    distinct = order[lead]
    back = np.empty(len(begin), np.int64)
    back[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
    first, count = known.look_up(v, hashes[distinct], data, begin[distinct], end[distinct])
    first, count = first[back], count[back]
    total = np.concatenate([[0], np.cumsum(count)])
    out = known.ids[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
    return out, total[np.searchsorted(begin, offsets, "left")]


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of a sequence of ids; bytes that are no text become U+FFFD."""
    return b"".join([v.surface[i] for i in ids])[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the pieces of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = shared.value, Known()
        for batch in it:
            data, offsets = tk.text_buffer(batch.column("text"))
            for a, b in tk.slices(offsets):
                ids, bounds = encode_slice(v, data[offsets[a] : offsets[b]], offsets[a : b + 1], known)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), lists], names=["id", "ids"])

    return docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(run, "id long, ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text): the texts of what ``encode`` returned."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in it:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [decode(v, x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, text string")


def op7_sentencepiece(spark, sf_dir: str, path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decoded(encode(docs, path), path)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
