"""Vectorised text primitives shared by the corpus operators.

Everything here works on Arrow string buffers: a batch is cut into slices of
about ``SLICE_BYTES`` bytes, and words, word hashes and window hashes of a slice
come from a handful of numpy passes, so no Python code runs per word.

Hashes are polynomial (Rabin-Karp) over random per-byte values modulo 2**64,
finished with a 64-bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Separators of alphanumeric words: every ASCII byte that is not a digit or letter.
NON_ALNUM = bytes(b for b in range(0x80) if not chr(b).isalnum())

_U = np.uint64
_GOLDEN, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> _U(30))) * _MIX1
        x = (x ^ (x >> _U(27))) * _MIX2
        return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, multiplier: int):
        self.p, self.q = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            with np.errstate(over="ignore"):
                for name, m in (("up", self.p), ("down", self.q)):
                    a = np.full(size, m, np.uint64)
                    a[0] = 1
                    setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(0x2545F4914F6CDD1D), _Powers(0xD1342543DE82EF95)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x632BE59BD9B4E019))
#: Of a second hash, independent of the first.
_BYTE_POWERS_2, _WORD_POWERS_2 = _Powers(0x9FB21C651E98DF25), _Powers(0xC2B2AE3D27D4EB4F)
_BYTE_VALUES_2 = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x27D4EB2F165667C5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _rolling(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.get(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=prefix[1:])
    return prefix, down


def spans_hash(values: np.ndarray, powers: _Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prefix, down = _rolling(values, powers)
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts])


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one longer row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


class Words:
    """The words of consecutive texts: byte spans, the text of each word, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes = WHITESPACE, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets - offsets[0]
        n = len(data)
        table = np.ones(256, bool)
        table[np.frombuffer(separators, np.uint8)] = False
        inside = table[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~cut[:n]
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~cut[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: first[i]..first[i+1] are the words of text i.
        self.first = np.searchsorted(self.starts, self.offsets, "left")
        self.counts = np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words joined by one space, as bytes, and where each word starts there."""
        size = self.ends - self.starts
        before = np.cumsum(size) - size
        at = before + np.arange(len(size))
        within = np.arange(size.sum())
        out = np.full(len(within) + len(size), 32, np.uint8)
        out[np.repeat(at - before, size) + within] = self.data[np.repeat(self.starts - before, size) + within]
        return out, at

    def hashes(self) -> np.ndarray:
        return spans_hash(_BYTE_VALUES[self.data], _BYTE_POWERS, self.starts, self.ends)

    def _places(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        per = np.maximum(self.counts - size + 1, 0)
        owner = np.repeat(np.arange(len(per)), per)
        position = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        return self.first[owner] + position, owner, position

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word (within the text) of every run of ``size`` words of one text."""
        prefix, down = _rolling(self.hashes(), _WORD_POWERS)
        at, owner, position = self._places(size)
        with np.errstate(over="ignore"):
            return mix((prefix[at + size] - prefix[at]) * down[at]), owner, position

    def second_windows(self, size: int) -> np.ndarray:
        """A hash of the same runs that is independent of the one of ``windows``."""
        words = spans_hash(_BYTE_VALUES_2[self.data], _BYTE_POWERS_2, self.starts, self.ends)
        prefix, down = _rolling(words, _WORD_POWERS_2)
        at = self._places(size)[0]
        with np.errstate(over="ignore"):
            return mix((prefix[at + size] - prefix[at]) * down[at])


def batches_of_words(batch: pa.RecordBatch, column: str, **options) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffer(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1], **options)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if len(ordered) == 0:
        return np.zeros(0, np.int64)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if len(ordered) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def split_by(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key in 0..n-1 and the n+1 bounds of each key in it."""
    order = np.argsort(key.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))])


def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A list array that cuts values at the given starts."""
    offsets = np.append(starts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
