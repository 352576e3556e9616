import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from skyloom.llm import license_scan as ls
from skyloom.llm import textkit as tk
from tests.llm.common import DOCS, ODD, docs, lower, prose


def base(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for p, label in ls.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "This is the MIT License. mit\nlicense, smit license mit licenses",
    "GNU General-Public  License and the Apache\tLicense.",
    "mit license" * 3,
    "License mit",
    prose(1, 40) + " MIT license",
]


def test_base_against_brute_force(spark):
    texts = [*TEXTS, *ODD]
    got = ls.find_notices(docs(spark, texts)).orderBy("id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [base(t) for t in texts]
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_notices_with_errors(spark):
    texts = [
        "x y Lisensed under the Apache Licence, Version 2.0! z",
        "All rights resrved",
        "Licensed under CC BY-NC 4.0.",
        "relased undr the MIT Lcense",
        "all the rights of the reserved",
    ]
    got = ls.find_notices(docs(spark, texts)).orderBy("id").collect()
    assert [r.labels for r in got] == ["apache", "proprietary", "cc-by-nc", "mit", ""]
    span = got[0].spans[0]
    assert (span.first, span.stop, span.errors) == (2, 10, 2) and 0 < got[0].score < 1
    assert got[4].score == 0 and got[4].first_word is None


def test_the_likest_of_overlapping_spans_stay():
    rng = random.Random(0)
    for _ in range(50):
        spans = [{"label": str(i), "first": a, "stop": a + rng.randint(1, 6), "likeness": rng.choice([0.8, 0.9, 1.0])} for i in range(25) for a in [rng.randint(0, 60)]]
        want = []
        for s in sorted(spans, key=lambda s: (-s["likeness"], s["first"] - s["stop"], s["first"], s["label"])):
            if all(s["stop"] <= x["first"] or s["first"] >= x["stop"] for x in want):
                want.append(s)
        assert ls._best(spans) == sorted(want, key=lambda s: s["first"])


def test_many_notices_in_one_text(spark):
    row = ls.find_notices(docs(spark, ["All rights reserved. MIT license! " * 3000])).first()
    assert row.n_base == 3000 and len(row.spans) == 3000


def test_every_error_budget_is_found():
    """Pigeonhole: an intact piece is left by any choice of edits within the budget."""
    for text in ls.NOTICES:
        k = len(text) // ls.CHARS_PER_ERROR
        cut = ls.pieces(text, k)
        assert len(cut) == k + 1 and "".join(p for _, p in cut) == text


def fewest_errors(notice, text):
    """The fewest edits that turn the notice into a piece of the text, by dynamic programming over characters."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(notice, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        text[i : i + rng.choice([0, 1])] = rng.choice([[], ["x"], ["é"], ["ж"], ["q"]])
    return "".join(text)


def test_fuzzy_search_against_dynamic_programming():
    rng = random.Random(4)
    names = list(ls.NOTICES)
    texts = []
    for i in range(160):
        name = rng.choice(names)
        parts = [prose(i, 6), edited(rng, name, rng.randint(0, len(name) // 10 + 2)), prose(1000 + i, 4)]
        texts.append(" ".join(parts[rng.randint(0, 1) :][: rng.randint(2, 3)]))
    data, offsets = tk.text_buffer(pa.array(texts))
    w = tk.Words(data, offsets, tk.NON_ALNUM, lower=True)
    spaced, at = w.spaced()
    whole = spaced.tobytes()
    bounds = [*at.tolist(), len(whole)]
    hits = 0
    for i, (got, raw) in enumerate(zip(ls.scan(w, every=True), texts)):
        text = whole[bounds[w.first[i]] : bounds[w.first[i + 1]]].decode().strip()
        for notice in ls._automaton()[0]:
            fewest = fewest_errors(notice.text, text)
            found = [s["errors"] for s in got["spans"] if s["notice"] == notice.text]
            assert bool(found) == (fewest <= notice.errors), (raw, notice.text, fewest, found)
            if found:
                assert min(found) == fewest
                hits += 1
    assert hits > 80


def test_notices_side_by_side_all_count(spark):
    texts = ["all rights resrved all rights reserved", "All rights resrved, x y z, all rights reserved", "áll rights reserved", "all ríghts résérved"]
    got = ls.find_notices(docs(spark, texts)).orderBy("id").collect()
    assert [len(r.spans) for r in got] == [2, 2, 1, 0]
    assert got[2].spans[0].errors == 1


def test_extra_columns_with_clashing_names(spark):
    rows = docs(spark, ["MIT license", None]).withColumns({c: F.lit(1) for c in ("id", "labels", "score", "spans")})
    assert [r.n_base for r in ls.find_notices(rows).orderBy("id").collect()] == [1, 0]


def test_empty_table(spark):
    assert ls.find_notices(spark.createDataFrame([], DOCS)).count() == 0
