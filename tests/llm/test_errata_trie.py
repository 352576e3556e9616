"""Spelling variants against a brute-force comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm import errata_trie as et
from tests.llm.common import ODD, docs, prose


def lower(word):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), word)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            code = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            n[run[: code % len(run)] + run[code % len(run) + 1 :] if code % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(n):
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form, None, n[w], len(near), None if form is None else n[form]]
    for w, row in out.items():
        end = w
        while out[end][0] is not None:
            end = out[end][0]
        row[1] = end
    return {w: tuple(row) for w, row in out.items()}


def table(spark, n):
    return spark.createDataFrame(sorted(n.items()), "word string, n long")


def results(df):
    got = df.collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def similar_words(seed, many, letters="abé"):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 3, 4, 8, 16, 40]) for _ in range(many)}


def test_pairs_are_found_once(spark):
    n = similar_words(1, 400)
    got = [frozenset((r["word"], r["other"])) for r in et.one_edit_pairs(table(spark, n)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in n for b in n if one_edit(a, b)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abÿ", min_size=1, max_size=5), st.integers(1, 30), min_size=1, max_size=40))
def test_variants_of_any_words(spark, n):
    assert results(et.spelling_variants(table(spark, n))) == brute(n)


def test_long_chains_end_at_the_last_form(spark):
    n = {"a" * (5 + i): 3 * 2**i for i in range(40)}
    assert results(et.spelling_variants(table(spark, n))) == brute(n)
    assert results(et.spelling_variants(table(spark, n)))["aaaaa"][1] == "a" * 44


def test_query(spark, tmp_path):
    rng = random.Random(5)
    stems = ["receive", "address", "señora", "naïveté", "übung", "straße", "Ärger", "house", "horse", "houses", "xhouse"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "", ",", "'s", "9", "-", "Ü", "ÿ×÷"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += [*ODD, "HOUSE House hOUSE", "HOUSE House hOUSE", "ärger ÄRGER Ärger ärger ärger"] + [prose(i, 60) for i in range(5)]
    nameless = docs(spark, [None, "house horse house"]).withColumn("doc_id", F.lit(None).cast("long"))
    docs(spark, texts).unionByName(nameless).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [*enumerate(texts), (None, None), (None, "house horse house")]
    want = brute(counted(rows))
    assert any(v[0] for v in want.values())
    assert results(et.op11_spelling_variants(spark, str(tmp_path))) == want


def test_nothing_to_find(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    got = et.op11_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_clashing_columns(spark, tmp_path):
    base = docs(spark, ["letter letter letter letters letters letters letters letters letters"] * 3)
    for c in ("word", "n", "run", "id", "at", "node", "step", "heavy"):
        base = base.withColumn(c, base["source"])
    base.write.parquet(f"{tmp_path}/documents.parquet")
    got = results(et.op11_spelling_variants(spark, str(tmp_path)))
    assert got["letter"][:2] == ("letters", "letters") and got["letters"][:2] == (None, "letters")
    assert {r["word"] for r in et.occurrences(base).collect()} >= {"letter", "letters"}
