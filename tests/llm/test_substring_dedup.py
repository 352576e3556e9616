import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyloom.llm import substring_dedup as sd
from skyloom.llm import textkit as tk
from skyloom.llm.work import unpack
from tests.llm.common import DOCS, ODD, docs, prose, words


def brute(texts, window):
    tokens = [words(t, fold=False) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in tokens for i in range(len(w) - window + 1))
    out = []
    for w in tokens:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, window, parts=3):
    got = sd.find_repeats(docs(spark, texts).repartition(parts), window).orderBy(F.col("rest.doc_id")).collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute(texts, window)
    for r in got:
        spans = [(s.start, s.end) for s in r.removed]
        assert sum(b - a for a, b in spans) == r.n_removed
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_against_brute_force(spark):
    shared = prose(1, 60)
    texts = [prose(i, 150) for i in range(10)] + [f"{prose(50 + i, 20)} {shared}  {prose(70 + i, 9)}" for i in range(6)]
    texts += [prose(3, 150), f"{prose(90, 40)}\n{prose(90, 40)}", "a " * 50, *ODD]
    check(spark, texts, 35)
    check(spark, texts, 5)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_WORDS", 1)
    check(spark, [prose(i % 4, 80) for i in range(12)], 20)


def test_window_is_exact(spark):
    a = prose(5, 35)
    check(spark, [a, f"x {a} y", " ".join(a.split()[:34]), a.replace(" ", "\n")], 35)


def test_empty_table_and_clashing_names(spark):
    assert sd.find_repeats(spark.createDataFrame([], DOCS)).count() == 0
    odd = docs(spark, [prose(1, 50), prose(1, 50)]).withColumns({"key": F.lit(1), "starts": F.lit("x"), "rest": F.lit(None).cast("int"), "bucket": F.lit(2)})
    out = sd.drop_repeats(odd)
    assert out.columns == odd.columns and {r.text for r in out.collect()} == {""}
    assert {r.n_chars for r in out.collect()} == {0}


def test_clean_texts_stay_as_they_are(spark):
    text = "Two  spaces\nand a line."
    assert sd.drop_repeats(docs(spark, [text, None])).orderBy("doc_id").collect()[0].text == text


def test_windows_must_agree_in_both_hashes(spark, monkeypatch):
    """Of windows whose first hashes collide only those of equal words are removed."""
    whole = tk.Words.windows
    monkeypatch.setattr(tk.Words, "windows", lambda w, size: (lambda h, *x: (h % np.uint64(50), *x))(*whole(w, size)))
    texts = [prose(i, 60, 5000) for i in range(6)]
    frame = pa.record_batch([pa.array(range(8)), pa.array([*texts, texts[0], texts[1]])], names=["key", "text"])
    found = [r for b in sd._blocks(35, 1 << 20)(iter([frame])) for r in b.to_pylist()]
    replies = [unpack(r["payload"]) for r in found if r["reply"]]
    assert {int(k) for key, _, _ in replies for k in key} == {0, 1, 6, 7}
