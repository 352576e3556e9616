import hashlib
import random

from pyspark.sql import functions as F

from skyloom.llm import order_minhash as om
from tests.llm.common import DOCS, ODD, prose


def run(spark, tmp_path, rows):
    path = f"{tmp_path}/{random.random()}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return om.op8_order_minhash(spark, path).collect()


def brute_tuples(spark, text, k=om.K, size=om.TUPLE):
    """Selection by plain Python over the same hashes."""
    words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return []
    hashed = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    grams = [tuple((hashed + [None] * k)[i : i + k]) for i in range(max(len(words) - k, 0) + 1)]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(grams)], "i int, " + ", ".join(f"h{j} long" for j in range(k)))
    kmer = [r[0] for r in rows.orderBy("i").select(F.shiftrightunsigned(F.xxhash64(*[f"h{j}" for j in range(k)]), 24)).collect()]
    seen, numbered = {}, []
    for i, g in enumerate(kmer):
        numbered.append((i, g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    rows = spark.createDataFrame(numbered, "i int, g long, nth int")
    occ = sorted((r[1], r[0]) for r in rows.select("i", F.shiftrightunsigned(F.xxhash64("g", "nth"), 24)).collect())
    out = []
    for b in range(1 << om.BIN_BITS):
        # From the mark on, and on from the start behind the last.
        around = [x for x in occ if x[0] >> (40 - om.BIN_BITS) >= b] + occ + occ
        out.append([x[0] for x in sorted(around[:size], key=lambda x: x[1])])
    rows = spark.createDataFrame(list(enumerate(out)), "b int, a array<long>").coalesce(1)
    return [r[0] << 32 | r[1] for r in rows.select("b", F.shiftrightunsigned(F.xxhash64("a"), 32)).orderBy("b").collect()]


def test_signature_against_brute_force(spark):
    for text in ["", "one", "one two", "a b c d e f g", "a b " * 30, prose(3, 120)]:
        got = spark.createDataFrame([(text,)], "t string").select(om.signature(F.col("t"))).first()[0]
        assert got == brute_tuples(spark, text), text


def test_edits_and_neighbours(spark, tmp_path):
    texts = [*ODD, *(prose(i, 30 + i) for i in range(40)), "ab", "é\U0001f600c"]
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in run(spark, tmp_path, rows)}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 100]
    assert sum(r.near_edited for r in long) > 5 * sum(r.near_next for r in long)


def test_equal_texts_and_order(spark, tmp_path):
    a = prose(1, 80).split()
    swapped = a[40:] + a[:40]
    got = {r.doc_id: r for r in run(spark, tmp_path, [(3, " ".join(a)), (2, "  ".join(a)), (1, " ".join(swapped)), (0, " ".join(random.Random(1).sample(a, 80)))])}
    assert got[3].fingerprint == got[2].fingerprint and got[3].near_next == 1
    assert 0.3 < got[2].near_next < 1  # a moved half keeps its k-mers, but not every order
    assert got[1].near_next < 0.2


def test_order_counts_in_short_texts_too(spark):
    a = prose(1, 20, 4000).split()
    rows = spark.createDataFrame([(" ".join(a), " ".join(a[10:] + a[:10]), " ".join(a[::-1]))], "a string, b string, c string")
    rows = rows.select(*[om.signature(F.col(c)).alias(c) for c in "abc"])
    near, far = rows.select(om.likeness(F.col("a"), F.col("b")), om.likeness(F.col("a"), F.col("c"))).first()
    assert 0 < near < 0.74 and far < 0.1


def test_one_bucket_is_one_task(spark, tmp_path):
    spark.createDataFrame([(i, prose(i, 20)) for i in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = om.op8_order_minhash(spark, str(tmp_path))
    at = [(r.doc_id, r.p) for r in out.withColumn("p", F.spark_partition_id()).collect()]
    assert len({p for _, p in at}) == 4
    runs = [p for _, p in sorted(at)]
    assert sum(x != y for x, y in zip(runs, runs[1:])) == 3


def test_ties_nulls_and_few_rows(spark, tmp_path):
    got = run(spark, tmp_path, [(1, "b c"), (1, "a b"), (None, None), (None, "x")])
    assert len(got) == 4
    one = run(spark, tmp_path, [(5, "abcd")])[0]
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    assert run(spark, tmp_path, []) == []
    both = run(spark, tmp_path, [(1, None), (2, "")])
    assert {(r.fingerprint, r.near_next, r.n_chars) for r in both} == {("", 1.0, 0)}


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = om.op8_order_minhash(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table_keeps_its_schema(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = om.op8_order_minhash(spark, str(tmp_path))
    assert out.count() == 0 and "near_next" in out.columns
