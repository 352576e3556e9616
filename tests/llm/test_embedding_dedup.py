import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(x, weight, cosine):
    n = np.sqrt((x * x).sum(1))
    hit = (x @ x.T) / (n[:, None] * n[None, :]) >= cosine
    np.fill_diagonal(hit, False)
    p, near = np.arange(len(x)), hit | np.eye(len(x), dtype=bool)
    while True:
        q = np.array([p[row].min() for row in near])
        q = q[q]
        if (q == p).all():
            return hit @ weight, p, hit
        p = q


def clouds(seed, dim=12):
    rng = np.random.default_rng(seed)
    x = [c + rng.normal(size=(25, dim)) * rng.choice([0.001, 0.05, 0.12, 0.4]) for c in rng.normal(size=(5, dim))]
    x = np.concatenate([*x, x[0][:4] * 3, rng.normal(size=(30, dim))])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("seed", range(6))
def test_dual_traversal_against_all_pairs(seed):
    x = clouds(seed)
    w = np.random.default_rng(seed).integers(1, 4, len(x))
    links, p, hit = brute(x, w, 0.98)
    got = ed.dual_join(x, w, None, None, 0.98)
    assert (got[0] == links).all() and (got[1] == p).all()
    k = len(x) // 3
    hit[:k, :k] = hit[k:, k:] = False
    assert (ed.dual_join(x[:k], w[:k], x[k:], w[k:], 0.98)[0] == hit @ w).all()


def test_cover_tree_nests_and_covers():
    x = clouds(1)
    x /= np.sqrt((x * x).sum(1))[:, None]
    t = ed.CoverTree(x).freeze()
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for i, kids in enumerate(t.children):
        own = t.order[t.start[i] : t.stop[i]]
        assert np.sqrt(((x[own] - x[t.center[i]]) ** 2).sum(1)).max() <= t.radius[i] + 1e-12
        if len(kids):
            assert t.center[kids[0]] == t.center[i]
            assert sorted(np.concatenate([t.order[t.start[k] : t.stop[k]] for k in kids]).tolist()) == sorted(own.tolist())


@pytest.mark.parametrize("block", [7, 40, 2048])
def test_frame_against_all_pairs(spark, block):
    x = np.concatenate([clouds(2), clouds(3)[:60]]).astype(np.float32)
    x = np.concatenate([x, x[:5], x[:5]])
    label = np.arange(len(x)) % 3
    label[-10:] = label[:5].tolist() * 2
    rows = [(1000 - 3 * i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label))]
    got = {r.id: r for r in ed.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    for g in range(3):
        at = np.flatnonzero(label == g)
        at = at[::-1]  # ids ascend
        links, p, _ = brute(x[at].astype(float), np.ones(len(at), int), 0.98)
        for k, i in enumerate(at):
            r = got[rows[i][0]]
            assert r.n_links == links[k] and r.component == rows[at[p[k]]][0]


def test_vectors_that_link_with_nothing(spark):
    good = [1.0, 2.0, 3.0]
    rows = [
        (1, good, 1), (2, good, 1), (3, good, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1),
        (8, [float("nan"), 2.0, 3.0], 1), (9, [float("inf"), 2.0, 3.0], 1), (10, [2.0, 4.0, 6.0], 1), (11, [1.0, 2.0], 1), (12, good, 2),
    ]
    got = {r.id: (r.n_links, r.component) for r in ed.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (2, 1) if i in (1, 2, 10) else (0, i) for i in range(1, 13)}


def test_any_label_and_any_size(spark):
    rows = [(i, [k * x for x in (1.0, 2.0, 3.0)], label) for label in ("a\0b", "a/b", "", "ab") for i, k in enumerate((1.0, 1e200, 1e-170, 5e-324, -1e300))]
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    got = {r.id: (r.n_links, r.component) for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {i: (0, i) if i % 5 == 4 else (3, 5 * (i // 5)) for i in range(20)}


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], SCHEMA).withColumns({c: F.lit(1) for c in ("id", "key", "cid", "vec", "n", "links")})
    assert sorted((r.id, r.n_links, r.component) for r in ed.near_vectors(rows).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_every_large_label_has_pivots_of_its_own(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tobytes(), f"l{i % 9}") for i in range(900)]
    found = ed.choose_pivots(spark.createDataFrame(rows, "cid long, vec binary, label string"), sample=10, block=20)
    assert len(found) == 9 and all(len(x) == 5 for x in found.values())


def test_empty_table_and_query(spark, tmp_path):
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in ed.op10_embedding_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False)]


def test_vectors_without_an_id_count_and_connect(spark):
    a, b, c = [1.0, 0.0], [1.0, 0.15], [1.0, 0.3]
    rows = [(5, a, 1), (None, a, 1), (9, a, 1), (None, b, 1), (7, c, 1), (None, [0.0, 1.0], 1), (None, [0.0, 2.0], 1), (None, None, 1), (None, a, 2)]
    got = sorted(((r.id, r.n_links, r.component) for r in ed.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    # a links with b, b with c; two vectors without ids link with each other alone.
    want = [(5, 3, 5), (None, 3, 5), (9, 3, 5), (None, 4, 5), (7, 1, 5), (None, 1, None), (None, 1, None), (None, 0, None), (None, 0, None)]
    assert got == sorted(want, key=str)
