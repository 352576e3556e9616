"""Vector codes against plain Python integers."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import part_codes as pc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=2):
    """The contract, number by number."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 16
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = [v for _, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])[:64]]
    books = [[cut(v, p) for v in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((far(cut(v, p), b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(16):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(best(v, p)[1], []).append(cut(v, p))
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for part in books for b in part for x in b).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        got = [best(v, p) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(f for f, _ in got), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


def made(seed, n, size=32, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(size)] for _ in range(5)]
    return [(i * 3 % 1009, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([0, 1, 2, None])) for i in range(n)]


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in pc.op13_vector_codes(spark, str(tmp_path)).collect()), key=str)


def test_against_brute_force(spark, tmp_path):
    rows = made(1, 300)
    rows += [(5000, None, 1), (5001, [None] * 32, 1), (5002, [float("nan")] + [0.0] * 31, 2), (5003, [float("inf")] * 32, 2), (None, [0.5] * 32, None)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_few_rows_ties_and_copies(spark, tmp_path):
    rows = [(i, [float(i % 3)] * 16, 7) for i in range(1, 9)] + [(20, [-0.001] * 16, None)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_more_entries_than_values(spark, tmp_path):
    rows = [(i, [float(i % 4)] * 16, i % 2) for i in range(200)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert {r[2] for r in got} == {0}


def test_other_lengths_stay_without_a_code(spark, tmp_path):
    rows = made(2, 40) + [(7000, [], 1), (7001, [1.0] * 16, 1), (7002, [1.0] * 31, 1), (7003, [1e9] * 32, 1)]
    got = {r[0]: r for r in run(spark, tmp_path, rows)}
    assert all(got[i][1] is None and got[i][2] is None for i in range(7000, 7004))
    rest = sorted((r for r in got.values() if r[0] < 7000), key=str)
    assert [r[:3] + r[4:] for r in rest] == [r[:3] + r[4:] for r in brute(rows[:40])]


def test_nothing_to_code(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    assert run(spark, tmp_path / "b", [(1, None, 1)]) == []
    (only,) = run(spark, tmp_path / "c", [(1, [1.0, 2.0], 1)])
    assert only[1] is None


def test_clashing_columns(spark, tmp_path):
    base = spark.createDataFrame(made(3, 50), SCHEMA)
    for c in ("rest", "code", "error", "vec", "block", "of", "label_error"):
        base = base.withColumn(c, F.lit("x"))
    base.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in pc.op13_vector_codes(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(made(3, 50))


def test_any_cut_into_tasks_gives_the_same_books(spark):
    rows = spark.createDataFrame(made(4, 500), SCHEMA)
    one = pc.train(rows.coalesce(1))
    assert (one == pc.train(rows.repartition(9), depth=3)).all()


def test_decoded_vectors_are_near(spark):
    rows = spark.createDataFrame(made(5, 400), SCHEMA)
    books = pc.train(rows)
    got = pc.decode(pc.encode(rows.withColumn("keep", F.col("embedding")), books), books).select("rest.keep", "approximate", "error").collect()
    for r in got:
        scaled = np.floor(np.array(r["keep"], float) * pc.SCALE)
        assert ((scaled - np.array(r["approximate"]) * pc.SCALE) ** 2).sum() == r["error"]
