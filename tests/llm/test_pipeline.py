from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from skyloom.llm import substring_dedup, simhash
from tests.llm.common import DOCS, ODD, docs, prose
from tests.llm.test_toxicity import corpus


def write(spark, path, texts, toxic):
    docs(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    texts, toxic = corpus(200)
    shared = " ".join(f"passage{i}" for i in range(60))
    texts += [prose(i, 80) + " " + shared + " " + prose(1000 + i, 80) for i in range(5)] + [prose(7777, 120)] * 3 + ["12345", None]
    toxic += [0] * 10
    write(spark, tmp_path, texts, toxic)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(frame)
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in kept[:4]]
    assert ids[0] == {i for i, t in enumerate(toxic) if not t}
    assert ids[0] - ids[1] == {208, 209}
    assert ids[1] - ids[2] >= {206, 207} and 205 in ids[2]
    assert ids[3] == ids[2]
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for f in kept[:4])
    left = {r.doc_id: r.text for r in kept[3].collect()}
    assert all("passage30" not in left[i] for i in range(200, 205))
    packed = kept[4].collect()
    assert {x for b in packed for x in b.doc_ids} == ids[3]
    # Each stage against its operator on the same input, and the whole run against the stages.
    assert {r.doc_id for r in simhash.drop_near_duplicates(kept[1]).collect()} == ids[2]
    assert {r.doc_id: r.text for r in substring_dedup.drop_repeats(kept[2]).collect()} == left
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == rows(kept[4])


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_every_query_sees_the_whole_table(spark, tmp_path):
    write(spark, tmp_path, [prose(i, 20) for i in range(30)] + [None], [0, 1] * 15)
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") and name.split("_")[0] not in ("op2", "op10"):
            got = query(spark, str(tmp_path))
            assert got.select("doc_id").distinct().count() == 31, name


#: Names that the operators use for columns of their own.
CLASHING = ("rest", "score", "bucket", "id", "u", "v", "component", "row", "sign", "kept_words", "lang_pred", "_gone", "none")


def odd_documents(spark):
    """Null, empty, blank, short, very long and repeated texts, a row of nulls, and extra columns."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate([*ODD, prose(1, 150), prose(1, 150), prose(2, 150)])]
    rows += [rows[-1], (None, None, None, None, None), (None, prose(3, 150), None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, tmp_path, name, stage):
    frame = odd_documents(spark)
    spark.createDataFrame([(i, 3, 0) for i in range(9)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, frame, str(tmp_path))
    rows = got.collect()
    every = [r.doc_id for r in frame.collect()]
    if name == "packing":
        starts = [s for b in rows for s in b.segments if s.start == 0]
        assert Counter(s.doc_id for s in starts) == Counter(every)
        assert all(b.used == sum(s.n_tokens for s in b.segments) <= b.capacity for b in rows)
        return
    assert got.columns == frame.columns
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    kept = Counter(r.doc_id for r in rows)
    no_letters = {0: 1, 1: 1, 2: 1, None: 1}
    near = {2: 1, 1: 1, 7: 1}
    gone = {"toxicity": {}, "language": no_letters, "near_duplicates": near, "substrings": {}}[name]
    assert kept == Counter(every) - Counter(gone)
    texts = [r.text for r in rows if r.doc_id == 5]
    assert len(texts) == 1 and (texts[0] == ODD[5] or name == "substrings")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, tmp_path, name, stage):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = odd_documents(spark).where("false")
    got = stage(spark, frame, str(tmp_path))
    assert got.collect() == []
    assert name == "packing" or got.columns == frame.columns
