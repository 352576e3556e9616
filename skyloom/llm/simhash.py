"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

Fingerprints within ``errors`` differing bits agree on at least two of the
``errors + 2`` blocks that 64 bits are cut into, so every pair of blocks keys one
copy of the distinct fingerprints, and all links lie inside a key's group. In a
partition the groups, sorted, are one binary trie: node pairs descend together,
add up differing bits, and go when the error budget is exceeded.

Only connectivity is asked for, so work that cannot change it is pruned too:
fingerprints that agree outside one 4-bit nibble link at once as a star (they
differ in 4 bits at most; wide ones link to near neighbours in a few orders), and a node pair whose leaves already share one local
component is dropped. A dense group of near copies therefore costs about its
size, not its square. A task returns a spanning forest of what it found.

Cases: null, empty or blank texts have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; equal fingerprints are one node,
however many documents share it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textkit as tk
from skyloom.llm.work import components, discard, exchange, pack, partitions, stored, tidy, unpack

SHINGLE, ERRORS, SEED = 4, 4, 42
#: Near copies: sets of five-word shingles, similarity 4/5.
NEAR_SHINGLE = 5
#: Cells that count how common shingles are, the chunks they travel in, and the size up to which a group's pairs are all proposed at once.
CELLS, CHUNKS, SMALL = 1 << 20, 64, 32
#: Shingles of a group of fingerprints that is checked in one place.
GROUP_SHINGLES = 1 << 23
_U = np.uint64


def fingerprint_slice(w: tk.Words, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of a slice of texts."""
    size = w.ends - w.starts
    spaced, at = w.spaced()
    text = spaced.tobytes()
    n = np.where(w.counts == 0, 0, np.maximum(w.counts - shingle + 1, 1))
    owner = np.repeat(np.arange(len(n)), n)
    first = w.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + shingle, w.first[owner + 1]) - 1
    digest = xxhash.xxh64_intdigest
    begin, end = at[first].tolist(), (at[last] + size[last]).tolist()
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin))
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(shingle: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [fingerprint_slice(w, shingle) for _, _, w in tk.batches_of_words(batch, "text", lower=True)]
            value = np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(value)], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row, as a long."""
    return docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(tidy(_fingerprints(shingle)), "id long, fp long")


def _cuts(errors: int) -> list[int]:
    return [round(64 * i / (errors + 2)) for i in range(errors + 3)]


def _keyed(errors: int, buckets: int):
    """A copy of each fingerprint for each pair of blocks, with the key that the two blocks make."""
    cuts = _cuts(errors)
    pairs = list(combinations(range(errors + 2), 2))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            block = [(fp >> _U(a)) & _U((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
            for t, (i, j) in enumerate(pairs):
                key = (_U(t) << _U(40)) | (block[i] << _U(20)) | block[j]
                bucket = (tk.mix(key) % _U(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["bucket", "key", "fp"])

    return run


class Forest:
    """Union-find over 0..n-1 with vectorised label propagation."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def _bit(fp: np.ndarray, level: int) -> np.ndarray:
    word, shift = divmod(level, 64)
    return (fp[:, word] >> _U(63 - shift)) & _U(1)


def _close_first(key: np.ndarray, fp: np.ndarray, errors: int, forest: Forest) -> None:
    """Link what is cheap to see, so that dense groups are connected before the traversal."""
    if fp.shape[1] == 1:
        if errors >= 4:
            for nibble in range(16):
                rest = fp[:, 0] & ~_U(0xF << (4 * nibble))
                order = np.lexsort((rest, key))
                same = (key[order][1:] == key[order][:-1]) & (rest[order][1:] == rest[order][:-1])
                forest.link(order[1:][same], order[:-1][same])
        return
    # Neighbours in the orders that start with each half word.
    for word in range(fp.shape[1]):
        for turn in (0, 32):
            lead = (fp[:, word] << _U(turn)) | (fp[:, word] >> _U(64 - turn)) if turn else fp[:, word]
            order = np.lexsort((lead, key))
            x, y = order[1:], order[:-1]
            near = (key[x] == key[y]) & (np.bitwise_count(fp[x] ^ fp[y]).sum(1) <= errors)
            forest.link(x[near], y[near])


def trie_join(key: np.ndarray, fp: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """Component labels (indices of rows) of rows sorted by (key, fp): rows of one key link at ``errors`` bits or fewer.

    ``fp`` is one or more 64-bit words a row, the first word and its highest bit first.
    """
    fp = fp if fp.ndim == 2 else fp[:, None]
    n = len(fp)
    forest = Forest(n)
    if n < 2:
        return forest.label
    _close_first(key, fp, errors, forest)
    start = tk.runs(key)
    stop = np.append(start[1:], n)
    big = stop - start > 1
    # Node pairs: leaf ranges [a0, a1) and [b0, b1), equal for a node with itself, and the bits spent.
    a0, a1 = start[big], stop[big]
    b0, b1, spent = a0, a1, np.zeros(len(a0), np.int16)
    bits = 64 * fp.shape[1]
    for level in range(bits):
        # Leaves that are in one component already cannot add to it.
        change = np.zeros(n + 1, np.int64)
        np.cumsum(forest.label[1:] != forest.label[:-1], out=change[1:n])
        open_ = (change[a0] != change[a1 - 1]) | (change[b0] != change[b1 - 1]) | (forest.label[a0] != forest.label[b0])
        a0, a1, b0, b1, spent = (x[open_] for x in (a0, a1, b0, b1, spent))
        # With no more bits left than budget, all leaves of two nodes link.
        sure = (spent + (bits - level) <= errors) & (a0 != b0)
        if sure.any():
            for x0, x1, y in ((a0, a1, b0), (b0, b1, a0)):
                size = (x1 - x0)[sure]
                leaf = np.repeat(x0[sure] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                forest.link(leaf, np.repeat(y[sure], size))
        # Two leaves are decided by all their bits.
        pair = ~sure & (a1 - a0 == 1) & (b1 - b0 == 1) & (a0 != b0)
        if pair.any():
            x, y = a0[pair], b0[pair]
            near = np.bitwise_count(fp[x] ^ fp[y]).sum(1) <= errors
            forest.link(x[near], y[near])
        a0, a1, b0, b1, spent = (x[~sure & ~pair] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            break
        one = np.zeros(n + 1, np.int64)
        np.cumsum(_bit(fp, level), out=one[1:], dtype=np.int64)
        am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])
        two = a0 != b0
        both = lambda *x: np.concatenate(x)
        a0, a1, b0, b1, spent = (
            both(a0, am, a0, am[two]),
            both(am, a1, am, a1[two]),
            both(b0, bm, bm, b0[two]),
            both(bm, b1, b1, bm[two]),
            both(spent, spent, spent + 1, spent[two] + 1),
        )
        live = (a0 < a1) & (b0 < b1) & (spent <= errors) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, spent = (x[live] for x in (a0, a1, b0, b1, spent))
    if len(a0):
        # All bits are spent: leaves of a node are equal, those of two nodes differ within budget.
        for x0, x1, y in ((a0, a1, b0), (b0, b1, a0)):
            size = x1 - x0
            leaf = np.repeat(x0 - (np.cumsum(size) - size), size) + np.arange(size.sum())
            forest.link(leaf, np.repeat(y, size))
    return forest.label


def _linked(errors: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)) for b in it]
        if not got:
            return
        key, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        label = trie_join(key, fp, errors)
        a = np.flatnonzero(label != np.arange(len(label)))
        pair = np.stack([fp[a], fp[label[a]]])
        low, high = pair.min(axis=0), pair.max(axis=0)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), pa.array(high[new].view(np.int64))], names=["a", "b"])

    return run


def near_groups(prints: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(id, fp) -> (id, fp, component): the smallest id that links of ``errors`` bits or fewer reach."""
    spark = prints.sparkSession
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    keyed = nodes.select("fp").mapInArrow(tidy(_keyed(errors, partitions(spark))), "bucket int, key long, fp long")
    edges = exchange(keyed).mapInArrow(tidy(_linked(errors)), "a long, b long")
    root = components(edges)
    joined = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component"))
    labelled = joined.join(lowest, "root").select("fp", "component")
    return prints.join(labelled, "fp").select("id", "fp", "component")


def shingle_sets(w: tk.Words, shingle: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order of text and hash, the text of each, and how many each text has."""
    hashes, owner, _ = w.windows(shingle)
    short = np.flatnonzero((w.counts > 0) & (w.counts < shingle))
    if len(short):
        lead = w.hashes()
        whole = np.array([np.bitwise_xor.reduce(tk.mix(lead[w.first[i] : w.first[i + 1]] + np.arange(w.counts[i]).astype(np.uint64))) for i in short], np.uint64)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, owner, np.bincount(owner, minlength=len(w.counts))


#: Salt of the second hash of a set.
PROOF = 0x9AE16A3B2F90404F


def _signs(hashes: np.ndarray, n: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash of each set; an empty set has 0. Another salt gives an independent hash."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = tk.mix(np.add.reduceat(tk.mix(hashes ^ _U(salt)), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64))
    return out.view(np.int64)


def _parity(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """256 cells a text, as 4 words: whether a cell holds an odd number of shingles. Sets differ in as many shingles as cells, at least."""
    cell = owner * 256 + (tk.mix(hashes) >> _U(56)).astype(np.int64)
    odd = (np.bincount(cell, minlength=256 * texts) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 256), axis=1, bitorder="little").view(np.uint64).reshape(-1, 4)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of a slice of texts; with a column ``group``, sets of different groups have no shingle in common."""
    group = tk.mix(batch.column("group").to_numpy().view(np.uint64)) if "group" in batch.schema.names else None
    for a, b, w in tk.batches_of_words(batch, "text", lower=True):
        h, owner, n = shingle_sets(w, shingle)
        if group is not None:
            h = tk.mix(h ^ group[a:b][owner])
            h = h[np.lexsort((h, owner))]
        yield a, b, h, owner, n


def _signed(shingle: int):
    """(id, sign, proof) of each row, and once a task how many texts have a shingle in each of ``CELLS`` cells, in chunks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, total = ["id", "sign", "proof", "chunk", "counts"], np.zeros(CELLS, np.uint32)
        for batch in it:
            signs, proofs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, h, _, n in _sets(batch, shingle):
                signs.append(_signs(h, n))
                proofs.append(_signs(h, n, PROOF))
                total += np.bincount((h & _U(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(signs)), pa.array(np.concatenate(proofs)), *none], names=names)
        none = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(CHUNKS), pa.int32()), pa.array([pack(x) for x in total.reshape(CHUNKS, -1)], pa.binary())], names=names)

    return run


def _summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in it:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[chunk] = total.get(chunk, 0) + unpack(counts)[0].astype(np.int64)
    for chunk, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([pack(counts)], pa.binary())], names=["chunk", "counts"])


def _prefixes(shingle: int, common, buckets: int):
    """The first shingles of each set, rare cells first, packed by bucket: of two sets that are alike these have one in common."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = common.value
        for batch in it:
            for _, _, h, owner, n in _sets(batch, shingle):
                sign, bits = _signs(h, n), _parity(h, owner, len(n))
                order = np.lexsort((h, weight[(h & _U(CELLS - 1)).astype(np.int64)], owner))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                # At 4/5 two sets share 4/5 of the larger at least.
                keep = place < np.repeat(n - (4 * n + 4) // 5 + 1, n)
                key, at = h[order][keep], owner[keep]
                first = np.zeros(len(n), bool)
                first[np.unique(sign, return_index=True)[1]] = True
                key, at = key[first[at]], at[first[at]]
                order, bound = tk.split_by((tk.mix(key) % _U(buckets)).astype(np.int64), buckets)
                for b in range(buckets):
                    own = order[bound[b] : bound[b + 1]]
                    if len(own):
                        here = np.zeros(len(n), bool)
                        here[at[own]] = True
                        payload = pack(key[own], (np.cumsum(here) - 1)[at[own]].astype(np.int32), sign[here], n[here].astype(np.int32), bits[here].ravel())
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "payload"])

    return run


class _Group:
    """The sets that have a shingle in common, for all shingles of a bucket: entries by key, size and sign."""

    def __init__(self, payloads: list[bytes]):
        parts, base = [unpack(p) for p in payloads], 0
        at = []
        for part in parts:
            at.append(part[1].astype(np.int64) + base)
            base += len(part[2])
        key, at = np.concatenate([p[0] for p in parts]), np.concatenate(at)
        sign, n, bits = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        self.sign, first, back = np.unique(sign, return_index=True, return_inverse=True)
        self.n, self.bits = n[first].astype(np.int64), bits.reshape(-1, 4)[first]
        at = back[at]
        order = np.lexsort((at, self.n[at], key))
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        key, at = key[new], at[new]
        size = np.diff(np.append(tk.runs(key), len(key)))
        some = np.repeat(size > 1, size)
        self.key, self.at = key[some], at[some]
        self.size = size[size > 1]
        self.start = np.cumsum(self.size) - self.size

    def close(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of sets their sizes and cells do not rule out."""
        total = self.n[x] + self.n[y]
        good = 9 * np.abs(self.n[x] - self.n[y]) <= total
        at = np.flatnonzero(good)
        good[at] = 9 * np.bitwise_count(self.bits[x[at]] ^ self.bits[y[at]]).sum(1, dtype=np.int64) <= total[at]
        return good

    def plausible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The close pairs, as one number each."""
        good = self.close(x, y)
        x, y = x[good], y[good]
        return np.unique(np.minimum(x, y) * len(self.n) + np.maximum(x, y))

    def pairs(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return self.sign[code // max(len(self.n), 1)], self.sign[code % max(len(self.n), 1)]

    def packed(self, use: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The entries that a mask picks as a payload again, and the sets that they name."""
        here, at = np.unique(self.at[use], return_inverse=True)
        return pack(self.key[use], at.astype(np.int32), self.sign[here], self.n[here].astype(np.int32), self.bits[here].ravel()), here

    def apart(self, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each set with the sets of a group that may link with it and are not known to; ``label`` may change meanwhile.

        Sets of a group's largest component come up as partners only.
        """
        for start, size in zip(self.start, self.size, strict=True):
            at = self.at[start : start + size]
            kinds, kind, count = np.unique(label[at], return_inverse=True, return_counts=True)
            if len(kinds) > 1:
                for x in at[kind != count.argmax()]:
                    other = at[label[at] != label[x]]
                    other = other[self.close(np.full(len(other), x), other)]
                    if len(other):
                        yield int(x), other


_FOUND = "a long, b long, bucket int, member long, payload binary"


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"a": pa.int64(), "b": pa.int64(), "bucket": pa.int32(), "member": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def _proposed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All plausible pairs of small groups; of large ones neighbours by size, and the group itself for ``_across``."""
    payloads, bucket = [], None
    for batch in it:
        if batch.num_rows:
            bucket = batch.column("bucket")[0].as_py()
            payloads += batch.column("payload").to_pylist()
    if not payloads:
        return
    g = _Group(payloads)
    del payloads
    size = np.repeat(g.size, g.size)
    ahead = size - 1 - (np.arange(len(g.at)) - np.repeat(g.start, g.size))
    found = []
    for k in range(1, SMALL):
        i = np.flatnonzero((ahead >= k) & ((size <= SMALL) | (k <= 2)))
        if not len(i):
            break
        found.append(g.plausible(g.at[i], g.at[i + k]))
    a, b = g.pairs(found)
    yield _rows(len(a), a=pa.array(a), b=pa.array(b))
    large = size > SMALL
    if large.any():
        yield from _members(g, large, bucket)


def _members(g: _Group, use: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
    payload, here = g.packed(use)
    yield _rows(1, bucket=pa.array([bucket], pa.int32()), payload=pa.array([payload], pa.binary()))
    yield _rows(len(here), bucket=pa.array(np.full(len(here), bucket, np.int32)), member=pa.array(g.sign[here]))


def _gathered(it: Iterator[pa.RecordBatch]) -> tuple[_Group, int, np.ndarray, list] | None:
    """A bucket's groups, the component of each set as an index, and the sets themselves where they came along."""
    payloads, member, root, sets, bucket = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for batch in it:
        if batch.num_rows:
            bucket = batch.column("bucket")[0].as_py()
        payloads += [p for p in batch.column("payload").to_pylist() if p is not None]
        one = batch.filter(batch.column("member").is_valid())
        member.append(one.column("member").to_numpy())
        root.append(one.column("root").to_numpy())
        sets += [np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else None for x in one.column("shingles")]
    if not payloads:
        return None
    g = _Group(payloads)
    member, root = np.concatenate(member), np.concatenate(root)
    order = np.argsort(member)
    place = order[np.searchsorted(member[order], g.sign)]
    _, label = np.unique(root[place], return_inverse=True)
    return g, bucket, label, [sets[i] for i in place]


def _unlinked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of large groups, the sets that may link with a set of another component."""
    got = _gathered(it)
    if got:
        g, bucket, label, _ = got
        needed = np.zeros(len(g.n), bool)
        for x, other in g.apart(label):
            needed[x] = needed[other] = True
        use = needed[g.at]
        if use.any():
            yield from _members(g, use, bucket)


def _across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of similarity 4/5 at least that join components in large groups: a forest, so no more rows than sets."""
    got = _gathered(it)
    if not got:
        return
    g, _, label, sets = got
    forest = Forest(len(g.n))
    first = np.unique(label, return_index=True)[1]
    forest.link(np.arange(len(label)), first[label])
    a, b = [], []
    for x, other in g.apart(forest.label):
        for i in range(0, len(other), 1024):
            part = other[i : i + 1024]
            part = part[forest.label[part] != forest.label[x]]
            if not len(part):
                continue
            size = g.n[part]
            shared = np.add.reduceat(tk.member(np.concatenate([sets[y] for y in part]), sets[x]), np.cumsum(size) - size, dtype=np.int64)
            for y in part[9 * shared >= 4 * (size + g.n[x])]:
                if forest.label[y] != forest.label[x]:
                    forest.link(np.array([x]), np.array([y]))
                    a.append(x)
                    b.append(y)
    yield pa.RecordBatch.from_arrays([pa.array(g.sign[np.array(a, np.int64)]), pa.array(g.sign[np.array(b, np.int64)])], names=["a", "b"])


def _own_sets(shingle: int, grouped: bool = False):
    """(sign, set) of the rows whose text has the sign they are looked up for: an id may have several texts. With ``grouped``, the group too."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            want = batch.column("sign").to_numpy()
            for a, b, h, _, n in _sets(batch, shingle):
                end = np.cumsum(n)
                own = np.flatnonzero(_signs(h, n) == want[a:b])
                sets = [h[end[i] - n[i] : end[i]].tobytes() for i in own]
                columns = {"sign": pa.array(want[a:b][own]), "shingles": pa.array(sets, pa.binary())}
                if grouped:
                    columns["group"] = pa.array(batch.column("group").to_numpy()[a:b][own])
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets have similarity 4/5 at least."""
    for batch in it:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            keep[i] = 9 * int(tk.member(x, y).sum()) >= 4 * (len(x) + len(y))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _proven(prints: DataFrame, labelled: DataFrame) -> DataFrame:
    """(id, component) of rows (id, sign, proof) by the components of signs (sign, proven, component); a row of another proof is by itself."""
    own = F.when(F.col("proof") == F.col("proven"), F.col("component")).otherwise(F.col("id"))
    return prints.join(labelled, "sign").groupBy("id").agg(F.min(own).alias("component"))


def near_copies(docs: DataFrame, shingle: int = NEAR_SHINGLE, id: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """(id, component) of rows linked by sets of shingles of similarity 4/5 at least: the smallest id that links reach.

    Exact: sets so alike share one of their first shingles in any common order
    (rare ones first, so that common lines bring few together), size and cells rule
    out only pairs that cannot be so alike, and the sets themselves decide the rest.
    Pairs of small groups, and neighbours by size in large ones, are rows; what may
    still join components of a large group is decided where the group lies, which
    returns a forest. Texts without words have the empty set and are copies of each other.

    A set is known by a 64-bit hash (its sign), and equal sets by a second, independent one as well: a row whose second
    hash is not that of the first row with its sign is another text and stays by itself. So unrelated texts are
    taken for copies only if all 128 bits agree. With a column ``group`` of longs only rows of one group are compared.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    apart = [docs[group].alias("group")] if group else []
    base = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"), *apart).where("id is not null")
    signed = stored(base.mapInArrow(tidy(_signed(shingle)), "id long, sign long, proof long, chunk int, counts binary"), "signed")
    counts = exchange(signed.where("chunk is not null").select((F.col("chunk") % n).alias("bucket"), "chunk", "counts"))
    weight = np.zeros((CHUNKS, CELLS // CHUNKS), np.int64)
    for chunk, total in counts.mapInArrow(tidy(_summed), "chunk int, counts binary").collect():
        weight[chunk] = unpack(total)[0]
    common = spark.sparkContext.broadcast(weight.ravel())
    prints = signed.where("chunk is null").select("id", "sign", "proof")
    first = F.min(F.struct("id", "proof"))
    nodes = stored(prints.groupBy("sign").agg(first["id"].alias("low"), first["proof"].alias("proven")), "nodes")
    found = stored(exchange(base.mapInArrow(tidy(_prefixes(shingle, common, n)), "bucket int, payload binary")).mapInArrow(tidy(_proposed), _FOUND), "found")

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = wanted.distinct().join(nodes, "sign").select("sign", "low")
        mine = base.join(places, base["id"] == places["low"]).select("sign", "text", *(["group"] if group else [])).mapInArrow(tidy(_own_sets(shingle)), "sign long, shingles binary")
        return stored(mine.dropDuplicates(["sign"]), "sets")

    pairs = stored(found.where("a is not null").select("a", "b").distinct(), "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sign")))
    one = sets.select(F.col("sign").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("sign").alias("b"), F.col("shingles").alias("y"))
    links = stored(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidy(_alike), "a long, b long"), "links")
    root = components(links)

    def large(rows: DataFrame, sets: DataFrame | None) -> DataFrame:
        """The members of large groups with their components (and sets), and the groups, in their buckets."""
        members = rows.where("member is not null").select("bucket", "member").join(root, F.col("member") == F.col("node"), "left")
        members = members.select("bucket", "member", F.coalesce("root", "member").alias("root"))
        if sets is None:
            members = members.withColumn("shingles", F.lit(None).cast("binary"))
        else:
            members = members.join(sets, F.col("member") == F.col("sign")).drop("sign")
        groups = rows.where("payload is not null").select("bucket", *(F.lit(None).cast(t).alias(c) for c, t in (("member", "long"), ("root", "long"), ("shingles", "binary"))), "payload")
        return exchange(members.withColumn("payload", F.lit(None).cast("binary")).union(groups))

    apart = stored(large(found, None).mapInArrow(tidy(_unlinked), _FOUND), "apart")
    wanted = apart.where("member is not null").select(F.col("member").alias("sign"))
    others = sets_of(wanted)
    more = stored(large(apart, others).mapInArrow(tidy(_across), "a long, b long"), "links")
    if not more.isEmpty():
        root = components(links.union(more))
    for done in (found, pairs, sets, links, apart, others, more):
        discard(done)
    joined = nodes.join(root, nodes["sign"] == root["node"], "left").select("sign", "low", "proven", F.coalesce("root", "sign").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component"))
    labelled = joined.join(lowest, "root").select("sign", "proven", "component")
    return _proven(prints, labelled)


def _grouped_signs(shingle: int):
    """(id, group, sign, proof, n) of each row: the two hashes of its set, and the set's size."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, h, _, n in _sets(batch, shingle):
                own = batch.slice(a, b - a)
                made = [pa.array(x) for x in (_signs(h, n), _signs(h, n, PROOF), n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("group"), *made], names=["id", "group", "sign", "proof", "n"])

    return run


def _linked_sets(table: pa.Table) -> pa.Table:
    """Links of similarity 4/5 at least between the sets of one group: a forest, so fewer rows than sets."""
    sign = table.column("sign").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
    n = np.array([len(x) for x in sets], np.int64)
    bits = _parity(np.concatenate(sets), np.repeat(np.arange(len(n)), n), len(n))
    forest, a, b = Forest(len(n)), [], []
    for x in range(len(n)):
        # Pairs with earlier sets are decided.
        other = x + 1 + np.flatnonzero(forest.label[x + 1 :] != forest.label[x])
        total = n[x] + n[other]
        other = other[(9 * np.abs(n[other] - n[x]) <= total) & (9 * np.bitwise_count(bits[other] ^ bits[x]).sum(1, dtype=np.int64) <= total)]
        for i in range(0, len(other), 1024):
            part = other[i : i + 1024]
            end = np.cumsum(n[part])
            shared = np.add.reduceat(tk.member(np.concatenate([sets[y] for y in part]), sets[x]), end - n[part], dtype=np.int64)
            for y in part[9 * shared >= 4 * (n[part] + n[x])]:
                if forest.label[y] != forest.label[x]:
                    forest.link(np.array([x]), np.array([y]))
                    a.append(x)
                    b.append(y)
    return pa.table({"a": sign[np.array(a, np.int64)], "b": sign[np.array(b, np.int64)]})


def checked_groups(docs: DataFrame, shingle: int = NEAR_SHINGLE, id: str = "doc_id", text: str = "text", errors: int = ERRORS) -> DataFrame:
    """(id, component) of rows that fingerprints group and whose shingle sets then prove alike; rows that stand alone are left out.

    ``near_groups`` links fingerprints. Within one of its groups, texts link whose sets of shingles have similarity 4/5 at least;
    component is the smallest id that these links reach. A group is decided where its distinct sets lie and gives a forest, never
    pairs. A group of more than ``GROUP_SHINGLES`` shingles is left to ``near_copies``, which finds the same links without bringing it to one task.
    """
    prints = stored(fingerprints(docs, id=id, text=text).where("id is not null"), "prints")
    groups = stored(near_groups(prints, errors), "groups")
    many = groups.groupBy("component").count().where("count > 1").drop("count")
    member = groups.join(many, "component").select(F.col("id").alias("_id"), F.col("component").alias("group")).distinct()
    base = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))
    base = stored(base.join(member, base["id"] == member["_id"]).select("id", "text", "group"), "candidates")
    signed = stored(base.mapInArrow(tidy(_grouped_signs(shingle)), "id long, group long, sign long, proof long, n long"), "signed")
    first = F.min(F.struct("id", "proof"))
    nodes = stored(signed.groupBy("sign").agg(first["id"].alias("low"), first["proof"].alias("proven"), F.min("group").alias("group"), F.max("n").alias("n")), "nodes")
    sizes = stored(nodes.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1"), "sizes")
    large = sizes.where(F.col("shingles") > GROUP_SHINGLES).select("group")
    places = nodes.join(sizes.where(F.col("shingles") <= GROUP_SHINGLES).select("group"), "group").select(F.col("group").alias("_group"), "low", "sign")
    mine = base.join(places, (base["id"] == places["low"]) & (base["group"] == places["_group"])).select("sign", "text", "group")
    sets = mine.mapInArrow(tidy(_own_sets(shingle, True)), "sign long, shingles binary, group long").dropDuplicates(["sign"])
    links = stored(sets.groupBy("group").applyInArrow(_linked_sets, "a long, b long"), "links")
    root = components(links)
    joined = nodes.join(root, nodes["sign"] == root["node"], "left").select("sign", "low", "proven", F.coalesce("root", "sign").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component"))
    found = _proven(signed.select("id", "sign", "proof"), joined.join(lowest, "root").select("sign", "proven", "component"))
    if not large.isEmpty():
        found = found.union(near_copies(base.join(large, "group"), shingle, "id", "text", "group")).groupBy("id").agg(F.min("component").alias("component"))
    found = stored(found, "checked")
    for done in (prints, groups, base, signed, nodes, sizes, links):
        discard(done)
    return found


def drop_near_duplicates(docs: DataFrame, shingle: int = NEAR_SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that are checked near copies of a smaller id; of rows that share an id all stay or go together."""
    gone = checked_groups(docs, shingle, id, text).where("component < id").select(F.col("id").alias("_gone"))
    return docs.join(gone, docs[id] == gone["_gone"], "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = stored(fingerprints(docs), "prints")
    found = near_groups(prints)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
