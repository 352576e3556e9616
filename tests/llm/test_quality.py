"""Quality: word vectors and pools against plain dictionaries, the network on made-up rows, and held-out accuracy."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyloom.llm import quality as q
from skyloom.llm import textkit as tk
from tests.llm.common import ODD, docs, prose

PLAIN = rb"[0-9A-Za-z\x00-\x08\x0E-\x1F\x80-\xFF]+|[!-/:-@\[-`{-\x7F]+"


def words(text):
    return re.findall(PLAIN, (text or "").encode())


def slot(word):
    (found,) = q.slots(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0]
    return int(found)


def junk(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{prose(seed * 100 + i, 1)}{rng.choice(['***', '&&&', '$$$'])}" for i in range(n)) if seed % 2 else " ".join(w for i in range(n // 4) for w in [prose(seed * 50 + i, 1)] * 4)


def test_words_and_slots():
    texts = [x for x in ODD if x] + ["a-b  c!!d", "the&&&", "\x01\x7f~é", "", "x"]
    data, offsets = tk.text_buffer(pa.array(texts))
    got, first = q.slots(data, offsets)
    for i, text in enumerate(texts):
        assert [slot(w) for w in words(text)] == got[first[i] : first[i + 1]].tolist()


def test_word_vectors(spark):
    texts = [*ODD[:5], "a b c d e", "the&&& cat, the dog", "a a a", prose(4, 300)]
    places, signs = q.index_vectors()
    want = np.zeros((q.SLOTS, q.WIDTH))
    for text in texts:
        seen = [slot(w) for w in words(text)]
        for i, s in enumerate(seen):
            for j in range(max(0, i - q.REACH), min(len(seen), i + q.REACH + 1)):
                if i != j:
                    want[s, places[seen[j]]] += signs[seen[j]]
    length = np.sqrt((want**2).sum(axis=1, keepdims=True))
    got = q.word_vectors(docs(spark, texts).repartition(3))
    assert np.allclose(got, want / np.maximum(length, 1))


def test_index_vectors_are_sparse_signs():
    places, signs = q.index_vectors()
    assert all(len(set(p)) == q.NONZERO for p in places.tolist()) and set(signs.ravel()) == {-1, 1}


def test_pool(monkeypatch):
    vectors = np.random.default_rng(0).normal(size=(q.SLOTS, q.WIDTH)).astype(np.float32)
    texts = ["", "one", "one one two", prose(8, 400), "", "x y"]
    data, offsets = tk.text_buffer(pa.array(texts))
    slots, first = q.slots(data, offsets)
    whole = q.pool(slots, first, vectors)
    for i, text in enumerate(texts):
        v = np.array([vectors[slot(w)] for w in words(text)], float).reshape(-1, q.WIDTH)
        mean = v.mean(axis=0) if len(v) else np.zeros(q.WIDTH)
        near = [float((v[:-k] * v[k:]).sum(axis=1).mean()) if len(v) > k else 0.0 for k in range(1, q.REACH + 1)]
        want = [*mean, *((v * v).mean(axis=0) * q.WIDTH if len(v) else mean), *near, np.sqrt((mean**2).sum()), not len(v)]
        assert np.allclose(whole[i], want, atol=1e-4)
    monkeypatch.setattr(q, "_AT_ONCE", 7)
    assert np.allclose(q.pool(slots, first, vectors), whole, atol=1e-4)


def test_network_learns_and_is_calibrated():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, q.FEATURES))
    truth = 1 / (1 + np.exp(-4 * x[:, 0] - 2 * np.abs(x[:, 1]) + 1.5))
    y = (draw.random(3000) < truth).astype(float)
    net = q.learn(x[:2400], y[:2400])
    p = net.probabilities(x[2400:])
    assert ((p >= 0.5) == (truth[2400:] >= 0.5)).mean() > 0.8
    kept = np.arange(2400) % q.KEPT_BACK == q.KEPT_BACK - 1
    logits = net.logits(x[:2400][kept])
    losses = [q._loss(logits / t, y[:2400][kept]) for t in (net.temperature, 0.9 * net.temperature, 1.1 * net.temperature, 1.0)]
    assert losses[0] == min(losses)


def test_few_labels():
    assert q.learn(np.zeros((0, q.FEATURES)), np.zeros(0)).probabilities(np.zeros((2, q.FEATURES))).tolist() == [0.5, 0.5]
    x = np.random.default_rng(1).normal(size=(6, q.FEATURES))
    assert (q.learn(x, np.ones(6)).probabilities(x) > 0.5).all()


def write(spark, path, texts, labels, extra=()):
    base = docs(spark, texts)
    for c in extra:
        base = base.withColumn(c, F.lit(1))
    base.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy_and_cases(spark, tmp_path):
    good = [prose(i, 40 + i % 90) for i in range(300)]
    bad = [junk(i, 40 + i % 60) for i in range(150)]
    texts = [*good, *bad, *ODD, good[0], good[0]]
    labels = [(i, int(i < 300), 0) for i in range(450)] + [(None, 1, 0), (3, None, 0), (5, 1, 0), (99999, 0, 0), (7, 4, 0)]
    write(spark, tmp_path, texts, labels, extra=("rest", "score", "draw", "label", "x", "id"))
    got = {r["doc_id"]: r for r in q.op12_quality(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(len(texts)))
    held = [i for i in range(450) if got[i]["held_out"]]
    assert len(held) > 60 and np.mean([got[i]["predicted"] == (i < 300) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[450]["score"] == got[451]["score"]
    assert got[456]["score"] == got[457]["score"] == got[0]["score"]


def test_no_labels_and_no_rows(spark, tmp_path):
    write(spark, tmp_path / "a", ["some text", None], [])
    assert [r["score"] for r in q.op12_quality(spark, str(tmp_path / "a")).collect()] == [0.5, 0.5]
    write(spark, tmp_path / "b", [], [(1, 1, 0)])
    assert q.op12_quality(spark, str(tmp_path / "b")).count() == 0


def test_order_and_tasks_do_not_matter(spark):
    base = docs(spark, [prose(i, 50) for i in range(40)])
    assert (q.word_vectors(base.coalesce(1)) == q.word_vectors(base.orderBy(F.desc("doc_id")).repartition(7))).all()
