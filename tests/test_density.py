"""Density clusters against the definition: every group at every reach, by sets."""

import numpy as np
import pytest

from skyloom.operators import density

SCHEMA = "id long, vec array<double>"


def brute(x, least, k):
    """Labels by the definition; groups of several clusters that meet at one reach meet at once."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, k - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    groups, alive, clusters = [{i} for i in range(n)], {}, []  # alive: a group's cluster, by its smallest point
    for w in np.unique(reach[np.triu_indices(n, 1)]):
        left, merged = list(groups), []
        while left:
            whole, parts = left.pop(), []
            parts.append(set(whole))
            while True:
                near = [g for g in left if (reach[np.ix_(sorted(whole), sorted(g))] <= w).any()]
                if not near:
                    break
                for g in near:
                    left.remove(g)
                    parts.append(g)
                    whole = whole | g
            merged.append(whole)
            if len(parts) == 1 or len(whole) < least:
                continue
            old = [alive.pop(min(p)) for p in parts if len(p) >= least]
            if len(old) == 1:
                c = old[0]
            else:
                c = {"came": [], "parts": old, "end": 0.0, "points": set()}
                clusters.append(c)
                for o in old:
                    o["end"] = 1 / max(w, 1e-100)
                    c["came"] += [o["end"]] * len(o["points"])
                    c["points"] |= o["points"]
            new = set().union(*[p for p in parts if len(p) < least] or [set()])
            c["came"] += [1 / max(w, 1e-100)] * len(new)
            c["points"] |= new
            alive[min(whole)] = c
        groups = merged
    label = np.full(n, -1)
    root = next(iter(alive.values())) if alive else None

    def value(c):
        mine = sum(c["came"]) - len(c["came"]) * c["end"]
        c["value"] = mine if mine > 1e-12 * sum(c["came"]) else 0.0
        below = sum(value(o) for o in c["parts"])
        c["chosen"] = c is not root and c["value"] > 0 and c["value"] >= below
        return max(c["value"], below)

    def stamp(c):
        if c["chosen"]:
            label[sorted(c["points"])] = label.max() + 1
        else:
            for o in c["parts"]:
                stamp(o)

    if root:
        value(root)
        stamp(root)
    return label


def same(got, want):
    """The same clusters, however they are numbered."""
    assert ((got < 0) == (want < 0)).all()
    pairs = {(a, b) for a, b in zip(got.tolist(), want.tolist())}
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def labels(spark, x, least, k, **options):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)
    got = {r.id: r.cluster_id for r in density.density_clusters(rows, "vec", least, k, id="id", **options).collect()}
    assert len(got) == len(x)
    return np.array([got[i] for i in range(len(x))])


def blobs(seed, sizes, noise, dim=3, scale=0.3):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.uniform(-4, 4, dim), scale * rng.uniform(0.3, 1.5), (s, dim)) for s in sizes]
    x = np.concatenate([*parts, rng.uniform(-8, 8, (noise, dim))])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("seed, least, k, block, segment", [(1, 5, 3, 1000, 1 << 18), (2, 8, 5, 20, 1 << 18), (3, 4, 2, 1000, 9), (4, 6, 6, 25, 16)])
def test_against_the_definition(spark, seed, least, k, block, segment):
    x = blobs(seed, [20, 14, 10], 8)
    got, want = labels(spark, x, least, k, block=block, segment=segment), brute(x, least, k)
    assert want.max() >= 1
    same(got, want)


def test_ties_and_copies(spark):
    """A lattice has few different reaches, copies have reach zero."""
    grid = [(i, j) for i in range(5) for j in range(4)]
    x = np.array([*grid, *[(20 + i, j) for i, j in grid], *[(50.0, 50.0)] * 9, *[(60.0, 0.0)] * 6, (100.0, 100.0)], float)
    for options in ({}, {"block": 15, "segment": 10}):
        same(labels(spark, x, 6, 4, **options), brute(x, 6, 4))


def test_trees_of_blocks_hold_the_tree_of_all():
    x = np.round(blobs(5, [30, 20], 10), 1)
    core = np.sort(density.least_distances(x.T.copy(), x.T.copy(), 3), axis=1)[:, -1]
    ids = np.random.default_rng(1).permutation(len(x))
    whole = set(zip(*map(list, density.spanning_tree(x.T.copy(), core, ids)[:2])))
    cut = [ids % 3 == i for i in range(3)]
    parts = set()
    for i in range(3):
        for j in range(i, 3):
            use = cut[i] | cut[j]
            parts |= set(zip(*map(list, density.spanning_tree(x[use].T.copy(), core[use], ids[use])[:2])))
    assert whole <= parts and len(whole) == len(x) - 1


def test_rows_without_a_usable_vector_and_clashing_names(spark):
    x = blobs(6, [20, 20], 0, scale=0.1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (3, x[1].tolist()), (90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan")] * 3), (94, [1.0] * 5)]
    base = spark.createDataFrame(rows, SCHEMA)
    for c in ("node", "row", "core", "part", "mid", "rank", "chosen", "cluster"):
        base = base.selectExpr("*", f"id AS {c}")
    got = density.density_clusters(base, "vec", 8, 4, id="id").collect()
    assert len(got) == len(rows) and got[0].__fields__ == [*base.columns, "cluster_id"]
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.cluster_id)
    assert all(by[i] == [-1] for i in range(90, 95))
    want = brute(np.array([v for _, v in rows[:42]]), 8, 4)
    assert by[None] == by[0] and by[3][0] >= 0 and len({c for v in by.values() for c in v}) == want.max() + 2
    # Clusters are numbered by their smallest id.
    assert by[0][0] in (-1, 0)


def test_too_few(spark):
    base = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, None)], SCHEMA)
    assert {r.cluster_id for r in density.density_clusters(base, "vec").collect()} == {-1}
    assert density.density_clusters(base.where("id > 5"), "vec").count() == 0
    one = spark.createDataFrame([(i, [float(i % 7)]) for i in range(40)], SCHEMA)
    assert density.density_clusters(one.where("id < 7"), "vec", 3).count() == 7


def test_query_labels_every_vector(spark, tmp_path):
    from skyloom.plans import probes

    x = blobs(7, [26, 20, 16], 8, dim=4)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.cluster_id for r in probes.QUERIES["clusters"](spark, str(tmp_path)).collect()}
    assert len(got) == 71 and got.pop(500) == -1
    same(np.array([got[i] for i in range(70)]), brute(x, 3, 3))
