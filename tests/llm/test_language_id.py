import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import language_id as li
from tests.llm.common import DOCS, ODD, docs

SYLLABLES = {"aa": ["the", "ing", "and", "sh"], "bb": ["eau", "que", "é", "ou"], "cc": ["sch", "ung", "ein", "ü"]}


def text(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def brute_grams(t):
    s = "".join(c if c.isalpha() else " " for c in t.lower())
    s = f" {' '.join(s.split())} "
    out = Counter()
    for n in (1, 2, 3):
        out.update(s[i : i + n] for i in range(len(s) - n + 1) if not (n == 1 and s[i] == " "))
    return out


def number(g):
    x = 0
    for c in g:
        x = x << 21 | (1 if c == " " else ord(c))
    return x


def brute_rank(c, size):
    return [g for _, g in sorted((-n, number(g)) for g, n in c.items())][:size]


def brute_predict(profiles, t, size):
    own = brute_rank(brute_grams(t), size)
    if not any(c.isalpha() for c in t or ""):
        return "und", 0.0
    cost = {lang: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(cost), key=cost.get)
    return best, 1 - cost[best] / (size * len(own))


def test_profiles_and_predictions_against_dictionaries(spark):
    langs = ["aa", "bb", "cc"] * 5
    texts = [text(x, i) for i, x in enumerate(langs)]
    profiles = li.learn(docs(spark, texts, langs=langs).repartition(3), size=50)
    for lang in SYLLABLES:
        total = sum((brute_grams(t) for t, x in zip(texts, langs) if x == lang), Counter())
        assert profiles[lang] == brute_rank(total, 50)
    fresh = [text(x, 100 + i) for i, x in enumerate(langs)] + [t for t in ODD if t and len(t) < 1000]
    got = li.predict(docs(spark, fresh), profiles, size=50).orderBy(F.col("rest.doc_id")).collect()
    for row, t in zip(got, fresh):
        lang, score = brute_predict(profiles, t, 50)
        assert row.lang_pred == lang and abs(row.score - score) < 1e-12
    assert [r.lang_pred for r in got[:15]] == langs


def test_ranks_of_many_grams_keep_ties_in_order():
    rng = np.random.default_rng(0)
    codes = rng.integers(2, 5000, 4000)
    counts = Counter(codes.tolist())
    assert li.ranked(codes, 20).tolist() == [g for _, g in sorted((-n, g) for g, n in counts.items())][:20]


def test_odd_texts(spark):
    profiles = li.learn(docs(spark, [text("aa", 1)], langs=["aa"]))
    rows = li.predict(docs(spark, [None, "", "12 !?", "中文", text("aa", 2, 5000)]), profiles).orderBy(F.col("rest.doc_id")).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "aa", "aa"]
    assert rows[3].score == 0.0 and all(0 <= r.score <= 1 for r in rows)


def test_nothing_learned_and_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert li.learn(empty) == {}
    assert li.predict(docs(spark, ["abc"]), {}).first().lang_pred == "und"
    assert li.predict(empty, {"aa": [97]}).count() == 0
    assert li.learn(docs(spark, ["abc"], langs=[None])) == {}


def test_filter_keeps_columns(spark):
    profiles = li.learn(docs(spark, [text("aa", 1)], langs=["aa"]))
    odd = docs(spark, [text("aa", 3), "123", None]).withColumns({"rest": F.lit(1), "score": F.lit("s"), "lang_pred": F.lit("?")})
    out = li.keep_identified(odd, profiles, 0.1)
    assert out.columns == odd.columns and [r.doc_id for r in out.collect()] == [0] and out.first().score == "s"


def test_held_out_accuracy(spark, tmp_path):
    langs = [list(SYLLABLES)[i % 3] for i in range(90)]
    docs(spark, [text(x, i, 30) for i, x in enumerate(langs)], langs=langs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in li.op5_language_id(spark, str(tmp_path)).collect()}
    out = [i for i in got if got[i].held_out]
    assert out and sum(got[i].lang_pred == langs[i] for i in out) / len(out) > 0.95
