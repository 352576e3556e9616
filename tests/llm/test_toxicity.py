import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import toxicity as tx
from tests.llm.common import DOCS, docs

INSULTS = ["nastygit", "foulbrute", "vilecur"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "quiet", "house", "stands", "green", "river", "stone", "garden", "window", "over", "small", "table"]
    texts, toxic = [], []
    for i in range(n):
        w = rng.choices(words, k=40) + [f"x{rng.randint(0, 10**6)}"]
        if i % 4 == 0:
            w.insert(rng.randint(0, 40), rng.choice(INSULTS))
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def fitted(spark):
    texts, toxic = corpus(300)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    return tx.fit(docs(spark, texts), labels)


def brute_restore(token, model):
    """The cheapest of all paths through the lattice, by enumeration."""
    options = []
    for i, ch in enumerate(token):
        sym = int(tx._SYMBOL[ord(ch)]) if ord(ch) < 128 else 27
        own = [(sym, ch, 0.0)] if sym else []
        own += [(ord(to) - 96, to, tx.SWAP) for to in tx.IMITATES.get(ch, "")]
        if ch in tx.SEPARATORS:
            own.append((None, "", tx.SKIP))
        elif i and ch == token[i - 1]:
            own.append((None, "", tx.AGAIN))
        elif not own:
            own.append((None, "", tx.SKIP))
        options.append(own)
    best = (float("inf"), "")
    for path in itertools.product(*options):
        x = y = 0
        total = 0.0
        for s, _, extra in path:
            total += extra
            if s is not None:
                total += model.cost[x][y][s]
                x, y = y, s
        total += model.cost[x][y][0]
        best = min(best, (total, "".join(t for _, t, _ in path)))
    return best


@pytest.mark.parametrize("token", ["n4styg1t", "f.o.u.l", "viiile", "t*e", "s7one", "é1é", "...", "a", "gr33n"])
def test_viterbi_against_all_paths(fitted, token):
    model = fitted[0]
    total, text = brute_restore(token, model)
    got = tx.restore(token, model)
    assert got == text or brute_restore(token, model)[0] == pytest.approx(total)


@pytest.mark.parametrize("split", [False, True])
def test_long_tokens_are_decoded_as_a_whole(fitted, split, monkeypatch):
    rng = random.Random(3)
    tokens = ["".join(rng.choices("natsy1g0.-f3uv ", k=rng.randint(60, 400))) for _ in range(30)]
    got = [tx.restore(t, fitted[0], split) for t in tokens]
    monkeypatch.setattr(tx, "SETTLE", 10**9)
    assert got == [tx.restore(t, fitted[0], split) for t in tokens]


def test_letters_before_a_spaced_word_do_not_hide_it(spark, fitted):
    texts = ["q " * k + "f o u l b r u t e" + " q" * (k % 3) for k in range(40)] + ["-" * k + "n4styg1t" + "-x" * k for k in range(1, 90, 8)]
    assert min(r.score for r in tx.score(docs(spark, texts), *fitted).collect()) >= 0.5


def test_character_model_sums_to_one(fitted):
    assert np.allclose(np.exp(-np.array(fitted[0].cost)).sum(2), 1)


@pytest.mark.parametrize("hidden", ["nastygit", "NastyGit!", "n4styg1t", "n.a.s.t.y.g.i.t", "n a s t y g i t", "nastyyyygit", "foulbru7e", "v1lecur"])
def test_disguises(spark, fitted, hidden):
    row = tx.score(docs(spark, [f"the quiet {hidden} stands", "the quiet 3rd house, 12:30"]), *fitted).orderBy(F.col("rest.doc_id")).collect()
    assert row[0].score >= 0.5 > row[1].score


def test_held_out(spark, tmp_path):
    texts, toxic = corpus(300, 1)
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 300 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == toxic[r.doc_id] for r in got if r.held_out)


def test_a_lone_word_does_not_taint_its_beginning(spark, fitted):
    """'nasty' begins one toxic word only, which says nothing about others."""
    assert tx.score(docs(spark, ["nastier weather"]), *fitted).first().score < 0.5


def test_odd_texts(spark, fitted):
    rows = tx.score(docs(spark, [None, "", " \n", "中文 ñ", "a" * 100_000, "1" * 5000 + "a", "a " * 5000]), *fitted).collect()
    assert all(r.score < 0.5 for r in rows) and len(rows) == 7


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    fit = tx.fit(docs(spark, ["some text"]), none)
    assert tx.score(docs(spark, ["some text"]), *fit).first().score == 0
    empty = spark.createDataFrame([], DOCS)
    assert tx.drop_toxic(empty, tx.fit(empty, none)).count() == 0


def test_filter_keeps_columns(spark, fitted):
    odd = docs(spark, ["a nastygit", "a house", None]).withColumns({"rest": F.lit(1), "score": F.lit("s")})
    out = tx.drop_toxic(odd, fitted)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_repeated_and_null_ids(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert tx.score(rows, *tx.fit(rows, labels)).count() == 3


@pytest.mark.parametrize("hidden", ["fovlbrute", "nastygitt", "nnaassttyyggiitt", "n.a.5.t.y.g.1.t", "n--a--s--t--y--g--i--t", "n - a - s - t - y - g - i - t", "n a s t y g i t!", "n4stygit!", "*v1lecur*"])
def test_every_disguise_is_opened(spark, fitted, hidden):
    assert tx.score(docs(spark, [f"the quiet {hidden} stands"]), *fitted).first().score >= 0.5


@pytest.mark.parametrize("text", ["you are a n a s t y g i t", "n a s t y g i t I say", "q u i e t v i l e c u r", "n a s t y g i t v i l e c u r", "so,v1lecur", "quiet,v.1.l.e.c.u.r"])
def test_separators_may_end_words(spark, fitted, text):
    assert tx.score(docs(spark, [text, "a q u i e t h o u s e"]), *fitted).where("score >= 0.5").count() == 1


@pytest.mark.parametrize("token", ["n4s.t", "so,1d", "a n a", "q u i e t", "--a"])
def test_boundary_arcs_against_all_paths(fitted, token):
    model, best = fitted[0], (float("inf"), "")
    where = [i for i, ch in enumerate(token) if ch in tx.SEPARATORS]
    options = []
    for i, ch in enumerate(token):
        sym = int(tx._SYMBOL[ord(ch)])
        own = [(sym, ch, 0.0)] if sym else []
        own += [(ord(to) - 96, to, tx.SWAP) for to in tx.IMITATES.get(ch, "")]
        own += [(None, "", tx.SKIP), (0, " ", 0.0)] if i in where else []
        own += [(None, "", tx.AGAIN)] if i and i not in where and ch == token[i - 1] else []
        options.append(own)
    for path in itertools.product(*options):
        x = y = 0
        total = 0.0
        for s, _, extra in path:
            total += extra
            if s is not None:
                total += model.cost[x][y][s]
                x, y = y, s
        best = min(best, (total + model.cost[x][y][0], "".join(t for _, t, _ in path)))
    assert tx.restore(token, model, split=True) == best[1]
