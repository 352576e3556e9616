"""Fixtures that the operators' tests share."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0, langs=None):
    rows = [(first + i, t, langs[i] if langs else "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())


def words(text, fold=True):
    return re.findall(rb"[^\x20\x09-\x0D]+", lower(text) if fold else (text or "").encode())


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.expovariate(1 / 60)) % vocabulary}" for _ in range(n))


#: Null, empty, blank, one word, other scripts, and a long text.
ODD = [None, "", " \t\n ", "word", "Ünïcode ñandú 中文 \U0001f600", prose(99, 30_000)]
