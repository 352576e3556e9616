import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyloom.llm import katz
from tests.llm.common import DOCS, ODD, docs, prose, words


def brute(train, texts):
    """log10 probabilities by plain dictionaries, and the sum over the vocabulary for some histories."""
    tok = lambda t: [*words(t), 1]
    one, two = Counter(), Counter()
    for t in train:
        x = tok(t)
        one.update(x)
        two.update(zip([0, *x], x, strict=False))
    n = sum(one.values())
    n_r = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.CUTOFF + 2)]
    d1, d2 = katz.discounts(n_r(one)), katz.discounts(n_r(two))
    keep = lambda c, d: d[c - 1] * c if c <= katz.CUTOFF else c - katz.TRIM
    p1 = {w: keep(c, d1) / n for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    total, mass, covered = defaultdict(int), defaultdict(float), defaultdict(float)
    for (h, w), c in two.items():
        total[h] += c
        mass[h] += keep(c, d2)
        covered[h] += p1[w]

    def p(h, w):
        if c := two.get((h, w)):
            return keep(c, d2) / total[h]
        alpha = (1 - mass[h] / total[h]) / (1 - covered[h]) if h in total else 1.0
        return alpha * p1.get(w, unknown)

    for h in list(total)[:20]:
        assert sum(p(h, w) for w in [*p1, b"never seen"]) == pytest.approx(1, abs=1e-9)
    out = []
    for t in texts:
        x = tok(t)
        score = sum(math.log10(p(h, w)) for h, w in zip([0, *x], x, strict=False))
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1))) for w in x)
        out.append((len(x), sum(w in one for w in x), base, score))
    return out


def test_against_dictionaries(spark):
    train = [prose(i, 40 + 30 * i) for i in range(40)] + ["The same text."] * 5
    texts = [*ODD, *train[:3], "never seen w1 w2 THE same", prose(77, 500)]
    fitted = katz.fit(docs(spark, train))
    got = katz.score(docs(spark, texts), fitted).orderBy("id").collect()
    for row, (n, known, base, score) in zip(got, brute(train, texts), strict=True):
        assert (row.n_tokens, row.n_known) == (n, known)
        assert row.base_score == pytest.approx(base, abs=1e-6)
        assert row.score == pytest.approx(score, abs=1e-6)


def test_blocks_and_buckets_do_not_matter(spark, monkeypatch):
    train = [prose(i, 200) for i in range(12)]
    whole = katz.score(docs(spark, train), katz.fit(docs(spark, train))).orderBy("id").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        parts = katz.score(docs(spark, train).repartition(5), katz.fit(docs(spark, train).repartition(3))).orderBy("id").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(whole.score, parts.score) and (whole.n_known == parts.n_known).all()


def test_no_training_and_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    fitted = katz.fit(empty)
    row = katz.score(docs(spark, ["a b"]), fitted).first()
    assert (row.n_tokens, row.n_known) == (3, 0) and row.score == 0.0
    assert katz.score(empty, katz.fit(docs(spark, ["a"]))).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = katz.score(rows, katz.fit(rows)).collect()
    assert sorted(str(r.id) for r in got) == ["1", "1", "2", "None"]
    assert len({r.score for r in got if r.id == 1}) == 1


def test_query_folds(spark, tmp_path):
    texts = [prose(i, 60) for i in range(30)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = katz.op1_katz(spark, str(tmp_path)).collect()
    out = {r.doc_id for r in got if r.held_out}
    assert out == {i for i in range(30) if zlib.crc32(str(i).encode()) % 5 == 1}
    assert got[0].train_tokens == sum(len(words(t)) + 1 for i, t in enumerate(texts) if i not in out)


def test_discounts_fall_back_where_counts_of_counts_are_thin():
    assert all(0 < d < 1 for d in katz.discounts([0] * 6) + katz.discounts([10, 3, 0, 0, 0, 0]))
    n = [0, 1000, 400, 210, 130, 90, 62]
    common = 6 * n[6] / n[1]
    want = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, 6)]
    assert katz.discounts(n[1:]) == pytest.approx(want) and all(0 < d < 1 for d in want)
