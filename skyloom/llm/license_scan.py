"""Fuzzy search for short license notices.

A notice of at most ``k`` errors keeps at least one of its ``k + 1`` pieces
intact (pigeonhole). An Aho-Corasick automaton finds the pieces of all notices
in one pass; around each hit the regex library's bounded-error matching verifies
the notice at every start, overlapping ones too, counts its edits and reports its
span. Of spans that overlap the likest stays.

Texts are compared as their words (see ``textkit.NON_ALNUM``), lower case, joined
by one space, so line breaks and punctuation do not count as errors. An error is a
character, however many bytes it takes.

Cases: a null text is empty; an empty text, or one without notices, has no labels,
null positions and score 0; repeated rows and ties are scanned each for itself; of a
very long text only the surroundings of hits are verified; other columns are not read;
an empty table has no rows.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skyloom.llm import textkit as tk

# Exact phrases, their labels, and short notices with theirs.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "all rights reserved": "proprietary",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "licensed under the apache license version 2 0": "apache",
    "mozilla public license version 2 0": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "released into the public domain": "public-domain",
    "released under the mit license": "mit",
    "this work is licensed under the gnu general public license": "gpl",
}
#: Characters of a notice for each error that is allowed in it.
CHARS_PER_ERROR = 10


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int
    pattern: regex.Pattern


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces of a text, each with its place."""
    cut = [round(len(text) * i / (errors + 1)) for i in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


@cache
def _automaton():
    """The notices, and an automaton over their pieces and the exact phrases."""
    notices, found = [], ahocorasick.Automaton()
    words: dict[str, list[tuple[int, int]]] = {}
    for text, label in NOTICES.items():
        errors = len(text) // CHARS_PER_ERROR
        notices.append(Notice(text, label, errors, regex.compile(rf"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={errors}}}")))
        for at, piece in pieces(text, errors):
            words.setdefault(piece, []).append((len(notices) - 1, at))
    for phrase in PHRASES:
        words.setdefault(phrase, []).append((-1, 0))
    for piece, uses in words.items():
        found.add_word(piece, (piece, uses))
    found.make_automaton()
    return notices, found


def scan(w: tk.Words, every: bool = False) -> list[dict]:
    """What each text of a slice holds: exact phrase places and verified notice spans (both by word); ``every`` keeps overlapping ones."""
    notices, automaton = _automaton()
    data, at = w.spaced()
    text = data.tobytes().decode("latin-1")
    bounds = np.append(at, len(text))[w.first]
    out: list[dict] = [{"base": [], "spans": []} for _ in w.counts]
    asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for end, (piece, uses) in automaton.iter(text):
        start = end + 1 - len(piece)
        doc = int(np.searchsorted(bounds, start, "right")) - 1
        low, high = int(bounds[doc]), int(bounds[doc + 1]) - 1
        if end >= high:
            continue
        for n, offset in uses:
            if n < 0:
                if (start == low or text[start - 1] == " ") and (end + 1 == high or text[end + 1] == " "):
                    out[doc]["base"].append((int(np.searchsorted(at, start)) - int(w.first[doc]), PHRASES[piece]))
            else:
                # An error takes four bytes at most.
                a, far = start - offset, 4 * notices[n].errors
                asked.setdefault((doc, n), []).append((max(low, a - far), min(high, a + len(notices[n].text) + far)))
    for (doc, n), windows in asked.items():
        windows.sort()
        joined = [list(windows[0])]
        for a, b in windows[1:]:
            if a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        for a, b in joined:
            for lo, hi, errors in _matches(notices[n], data[a:b]):
                word = int(np.searchsorted(at, a + lo, "right")) - 1
                stop = int(np.searchsorted(at, a + hi - 1, "right"))
                first = int(w.first[doc])
                out[doc]["spans"].append({"notice": notices[n].text, "label": notices[n].label, "first": word - first, "stop": stop - first, "errors": errors, "likeness": 1 - errors / len(notices[n].text)})
    for got in out:
        got["spans"] = got["spans"] if every else _best(got["spans"])
    return out


def _matches(notice: Notice, data: np.ndarray) -> list[tuple[int, int, int]]:
    """(first byte, end, errors) of a notice's matches, from every place where one can start."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(begins):
        return []
    # A stretch may begin and end within a character.
    part = data[begins[0] :].tobytes().decode("utf-8", "ignore")
    ends = np.append(begins, len(data))
    return [(int(ends[m.start()]), int(ends[m.end()]), sum(m.fuzzy_counts)) for m in notice.pattern.finditer(part, overlapped=True)]


def _best(spans: list[dict]) -> list[dict]:
    """Of spans that overlap, the likest, then the longest, then the first."""
    # Chosen spans do not overlap, so only the neighbours by start can.
    starts: list[int] = []
    chosen: dict[int, dict] = {}
    for s in sorted(spans, key=lambda s: (-s["likeness"], s["first"] - s["stop"], s["first"], s["label"])):
        i = bisect(starts, s["first"])
        if (i == 0 or chosen[starts[i - 1]]["stop"] <= s["first"]) and (i == len(starts) or starts[i] >= s["stop"]):
            starts.insert(i, s["first"])
            chosen[s["first"]] = s
    return [chosen[x] for x in starts]


_OUT = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<notice:string,label:string,first:long,stop:long,errors:long,likeness:double>>"
)


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("notice", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("errors", pa.int64()), ("likeness", pa.float64())]))
    for batch in it:
        rows = []
        for _, _, w in tk.batches_of_words(batch, "text", separators=tk.NON_ALNUM, lower=True):
            for n, got in zip(w.counts.tolist(), scan(w), strict=True):
                base, spans = got["base"], got["spans"]
                starts = [x for x, _ in base]
                exact = sorted({x for _, x in base})
                score = 1.0 if base else max((s["likeness"] for s in spans), default=0.0)
                every = sorted({*exact, *(s["label"] for s in spans)})
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(exact), ",".join(every), score, spans))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def find_notices(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, exact phrase places, labels, score and the notice spans."""
    return docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(_scan, _OUT)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = find_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")
