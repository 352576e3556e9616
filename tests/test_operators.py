import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.operators import dossier, kernels, rarity, relation, rollup, sequence, statistics


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ragged_buckets(spark):
    rows = frame(spark, [(0, i, float(i)) for i in range(10)], "g int, i int, v double")
    got = rollup.bucketed(rows, 4, ["g"], "i").groupBy("bucket").agg(F.max("v"), F.avg("v")).orderBy("bucket").collect()
    assert [tuple(r)[1:] for r in got] == [(3.0, 1.5), (7.0, 5.5), (9.0, 8.5)]


def test_lowest_mode(spark):
    rows = frame(spark, [(0, x) for x in (1, 1, 1, 2)] + [(1, 5)] * 4 + [(2, x) for x in (9, 3, 9, 3)], "g int, leaf int")
    assert [r[1] for r in rows.groupBy("g").agg(rollup.lowest_mode("leaf")).orderBy("g").collect()] == [1, 5, 3]


def test_histograms_merge_and_pmf_sums_to_one(spark):
    rows = frame(spark, [(x,) for x in (0, 0, 1, 2, 2, 2)], "leaf int")
    h = rarity.histogram(rows, "leaf")
    again = rarity.merge_histograms(rarity.histogram(rows.where("leaf < 2"), "leaf"), rarity.histogram(rows.where("leaf >= 2"), "leaf"), "leaf")
    assert sorted(h.collect()) == sorted(again.collect())
    assert rarity.pmf(h).agg(F.sum("p")).first()[0] == pytest.approx(1)
    spine = spark.range(8).select(F.col("id").cast("int").alias("leaf"))
    assert rarity.uniform_pmf(spine, h, "leaf").agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert {r.p for r in rarity.uniform_pmf(spine, h.limit(0), "leaf").collect()} == {0.125}


def test_range_check(spark):
    with pytest.raises(Exception, match="out of range"):
        rarity.check_range(frame(spark, [(9999,)], "leaf int"), "leaf").collect()


def test_weighted_percentiles_rise(spark):
    t = rarity.rarity_table(frame(spark, [(i, 2**i) for i in range(12)], "leaf int, n long"))
    got = [rarity.weighted_percentile(t, q).first()[0] for q in (0.5, 0.99, 0.9999)]
    assert got == sorted(got)


def test_runs_with_nulls_and_repeats(spark):
    rows = frame(spark, [(1, i, t) for i, t in enumerate("aabbbaNNa")] + [(2, 0, "z")], "node int, t int, token string")
    rows = rows.withColumn("token", F.nullif("token", F.lit("N")))
    got = sorted((r.node, r.token or "-", r.run_len) for r in sequence.runs(rows, "node", ["t"], "token").collect())
    assert got == [(1, "-", 2), (1, "a", 1), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "z", 1)]


def test_transitions_leave_out_stays(spark):
    rows = frame(spark, [(1, i, t) for i, t in enumerate("aabaca")], "node int, t int, token string")
    got = {(r.prev, r.token): r.probability for r in sequence.transitions(rows, "node", ["t"], "token").collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "a"): 1.0, ("c", "a"): 1.0}


def test_gradient_matches_numpy(spark):
    x = [0.0, 1.0, 4.0, 9.0, 16.0]
    rows = frame(spark, [(0, i, v) for i, v in enumerate(x)], "g int, i int, v double")
    along = Window.partitionBy("g").orderBy("i")
    assert [r[0] for r in rows.orderBy("i").select(sequence.gradient(F.col("v"), F.col("i"), along)).collect()] == np.gradient(x).tolist()
    assert rows.limit(1).select(sequence.gradient(F.col("v"), F.col("i"), along)).first()[0] is None


def test_sliding_windows_drop_the_tail(spark):
    rows = frame(spark, [(i,) for i in range(23)], "i int")
    got = sequence.sliding(rows, "i", 8, 4).groupBy("window").agg(F.min("i"), F.max("i"), F.count("*")).orderBy("window").collect()
    assert [tuple(r) for r in got] == [(w, 4 * w, 4 * w + 7, 8) for w in range(4)]


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.poisson(5, (40, 4))
    m[:, 3] = 7
    rows = frame(spark, [(i, j, int(m[i, j])) for i in range(40) for j in range(4)], "day int, token int, v int")
    got = {(r.a, r.b): r.corr for r in statistics.correlations(rows, "day", "token", "v").collect()}
    want = np.corrcoef(m[:, :3].T)
    assert set(got) == {(0, 1), (0, 2), (1, 2)} and all(got[a, b] == pytest.approx(want[a, b]) for a, b in got)


@pytest.mark.parametrize("few", [100_000, 7])
def test_quantiles_against_numpy(spark, few):
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=501), rng.integers(0, 5, 400).astype(float), np.array([3.0] * 50 + [1e9]), np.array([2.0]), np.exp(rng.normal(size=300) * 20)):
        df = frame(spark, [(float(v),) for v in x] + [(None,)], "v double")
        for q in (0.25, 0.5, 1.0):
            assert statistics.quantile(df, F.col("v"), q, few, bins=8) == pytest.approx(np.quantile(x, q))
    assert statistics.quantile(frame(spark, [], "v double"), F.col("v"), 0.5) is None


@pytest.mark.parametrize("few", [3, 100_000])
def test_quantiles_of_values_that_are_not_finite(spark, few):
    inf, nan = float("inf"), float("nan")
    rows = [(float(i), float(-i)) for i in range(17)] + [(inf, -inf), (inf, nan), (None, nan), (1e308, -1e308), (-1e308, 1e308)]
    got = statistics.quantiles(frame(spark, rows, "a double, b double"), {"a": (F.col("a"), [0.0, 0.5, 0.9, 1.0]), "b": (F.col("b"), [0.0, 0.5, 1.0])}, few, 4)
    a, b = sorted(x for x, _ in rows if x is not None), [-inf, -1e308, *(float(-i) for i in range(16, -1, -1)), 1e308, nan, nan]
    assert got["a"] == [a[0], a[10], a[18], inf]
    assert got["b"][:2] == [-inf, b[10]] or got["b"][1] == pytest.approx((b[10] + b[11]) / 2)
    assert math.isnan(got["b"][2])


def test_rarity_counts_every_token(spark):
    hist = frame(spark, [(5, 3), (9000, 2)], "t int, n long")
    got = {r.t: r.rarity for r in rarity.score_rows(frame(spark, [(5,), (9000,), (7,)], "t int"), hist, "t").collect()}
    want = {r.t: r.rarity for r in rarity.rarity_table(hist).collect()}
    assert got[5] == want[5] and got[9000] == want[9000] < got[7]


def test_graph_components_against_label_propagation(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 300
    token, pair = rng.integers(0, 3, n), rng.integers(0, n, (500, 2))
    chain = np.stack([np.arange(100), np.arange(1, 101)], 1)
    token[:101] = 1
    pair = np.concatenate([pair, chain])
    nodes = frame(spark, [(int(i), int(t)) for i, t in enumerate(token)], "node long, token long")
    edges = frame(spark, [(int(a), int(b)) for a, b in pair], "src long, dst long")
    label = kernels.label_components(token, pair[:, 0], pair[:, 1])
    got = {r.token: (r.n_components, r.largest_fraction) for r in kernels.graph_components(nodes, edges, str(tmp_path)).collect()}
    for t in range(3):
        sizes = np.bincount(label[token == t])
        sizes = sizes[sizes > 0]
        assert got[t] == (len(sizes), pytest.approx(sizes.max() / sizes.sum()))


def test_fano_counts_gaps(spark):
    counts = frame(spark, [("a", 0, 4), ("a", 2, 4)], "token string, bin int, n int")
    dense = statistics.completed(counts, counts.select("token").distinct(), spark.range(4).select(F.col("id").cast("int").alias("bin")), "n")
    assert statistics.fano(dense, "token", "n").first().fano == pytest.approx(2.0)


def test_dominant_period(spark):
    days = [d for d in range(64) if d % 8 == 0 or d % 16 == 3]
    rows = frame(spark, [("t", d, 10 if d % 8 == 0 else 1) for d in days] + [("u", 0, 1)], "token string, day int, v int")
    got = statistics.dominant_period(rows, "token", "day", "v").where("token = 't'").first()
    assert min(abs(got.period_days - 8 / k) for k in (1, 2, 3, 4)) < 0.2 and 0 < got.power_fraction <= 1
    few = frame(spark, [("t", d, d) for d in range(5)], "token string, day int, v int")
    assert statistics.dominant_period(few, "token", "day", "v").count() == 0


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x @ [2.0, 0.0, -1.0] + 0.01 * rng.normal(size=300)
    rows = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"]))
    got = statistics.ridge(statistics.moments(rows, ["a", "b", "c"], "y").first(), 3)
    assert got == pytest.approx([2, 0, -1], abs=0.02)
    shares = statistics.attribution(got, ["p", "q", "p"])
    assert sum(shares.values()) == pytest.approx(1) and shares["p"] > 0.98


def test_k_nearest_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[10] = x[11]
    df = relation.normalised(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    for block in (65536, 17):
        monkeypatch.setattr(relation, "BLOCK_ROWS", block)
        got = {}
        for r in relation.k_nearest(df, df, 4, drop_self=True).collect():
            got.setdefault(r.src, {})[r.slot] = round(r.score, 9)
        for i in range(60):
            want = sorted((s[i, j] for j in range(60) if j != i), reverse=True)[:4]
            assert [got[i][k] for k in (1, 2, 3, 4)] == pytest.approx(want)


def test_two_level_codes(spark):
    rng = np.random.default_rng(3)
    macro, micro = rng.normal(size=(4, 3)), rng.normal(size=(4, 5, 3)) * 0.3
    x = rng.normal(size=(50, 3))
    got = relation.two_level_code(
        frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"),
        frame(spark, [(i, v.tolist()) for i, v in enumerate(macro)], "macro int, vec array<double>"),
        frame(spark, [(i, j, micro[i, j].tolist()) for i in range(4) for j in range(5)], "macro int, micro int, vec array<double>"),
    )
    for r in got.collect():
        m = int(((macro - x[r.id]) ** 2).sum(1).argmin())
        assert r.macro == m and r.micro == int(((micro[m] - (x[r.id] - macro[m])) ** 2).sum(1).argmin())


def test_code_updates_conserve_mass(spark):
    codes = frame(spark, [(0, 10.0, [10.0, 0.0]), (1, 10.0, [0.0, 10.0])], "code int, size double, vec array<double>")
    seen = frame(spark, [(0, i, 1.0) for i in (0, 1)] * 5, "code int, i int, x double")
    got = {r.code: r for r in relation.updated_codes(seen, codes, decay=0.9).collect()}
    assert got[0]["size"] == pytest.approx(0.9 * 10 + 0.1 * 5) and got[1]["size"] == pytest.approx(9)
    assert got[0].vec[0] == pytest.approx((0.9 * 10 * 10 + 0.1 * 5) / got[0]["size"], rel=1e-3)


def test_isolation_against_numpy(spark):
    x = np.random.default_rng(4).normal(size=(20, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T).sum(1) - 1) / 19
    got = relation.isolation(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")).collect()
    assert all(r.mean_cosine == pytest.approx(want[r.id]) for r in got)
    assert max(got, key=lambda r: r.percentile).id == int(want.argmin()) and max(r.percentile for r in got) == 95


def test_components_of_a_frame(spark):
    edges = frame(spark, [(0, 1), (1, 2), (2, 3), (3, 2)], "src int, dst int")
    rows = frame(spark, [(0, n, t) for n, t in enumerate([5, 5, 9, 9])] + [(1, n, 5) for n in range(4)], "frame int, node int, token int")
    got = {(r.frame, r.token): (r.n_components, r.largest_fraction) for r in kernels.token_components(rows, edges).collect()}
    assert got == {(0, 5): (1, 1.0), (0, 9): (1, 1.0), (1, 5): (1, 1.0)}
    split = kernels.label_components(np.array([1, 2, 1, 1]), np.array([0, 1, 2]), np.array([1, 2, 3]))
    assert split.tolist() == [0, 1, 2, 2]


def test_principal_axes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)) * [5, 1, 0.5, 0.1]
    got = kernels.principal_axes(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>"), 2)
    share = got.groupBy("axis").count().collect()
    assert {r.axis for r in share} == {1, 2} and max(share, key=lambda r: r["count"]).axis == 1


def test_circular_mean(spark):
    rows = frame(spark, [("same", 1.0)] * 5 + [("even", 2 * math.pi * i / 10) for i in range(10)], "g string, a double")
    got = {r.g: r for r in statistics.circular_mean(rows, ["g"], F.col("a")).collect()}
    assert got["same"].concentration == pytest.approx(1) and got["same"].mean_angle == pytest.approx(1) and got["even"].concentration < 1e-9


def test_raster_and_flow(spark):
    rows = frame(spark, [(90.0 - r * 45 - 1, -180.0 + c * 90 + 1, float(c)) for r in range(4) for c in range(4)], "lat double, lng double, x double")
    grid = rollup.raster(rows, "x", 4, 4)
    got = {(r.row, r.column): r for r in rollup.flow(grid, "x").collect()}
    assert len(got) == 16 and got[1, 1].flow_x == 1.0 and got[1, 1].flow_y == 0.0 and got[1, 0].flow_x == 0.5


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(7)
    rows = [(f, 588465.5 + f / 8, n, int((n // 10 + f // 30 + rng.integers(0, 2)) % 5)) for f in range(240) for n in range(40)]
    return frame(spark, rows, "frame_ord long, jd double, node_id int, token_id int").cache()


def test_dossier(spark, log):
    edges = frame(spark, [(n, (n + 1) % 40) for n in range(40)], "src int, dst int")
    across = frame(spark, [(n, (n + 20) % 40) for n in range(40)], "src int, dst int")
    got = dossier.build(spark, log, edges, across, 64)
    tokens = {r.token_id: r for r in got["tokens"].collect()}
    assert len(tokens) == 64 and sum(r.activations or 0 for r in tokens.values()) == 240 * 40
    assert tokens[0].transition_top_to is not None and 0 <= tokens[0].transition_top_prob <= 1 and tokens[0].dwell_frames_mean >= 1
    assert tokens[63].activations is None and all(-1 <= r.corr < 0 for r in got["exclusion"].collect())
    assert got["symbiosis"].where("rank = 1").count() == 5 and got["antipode"].where("a = b").count() == 0
    lite = dossier.build(spark, log, edges, across, 64, lite=True)
    first = lite["tokens"].where("token_id = 0").first()
    assert all(first[c] is None for c in dossier.RELATION_COLUMNS) and first.activations == tokens[0].activations and lite["transitions"].count() == 0


def test_daily_volume_takes_the_first_frame(log):
    v = dossier.daily_volume(log)
    assert v.groupBy("day_index").agg(F.sum("volume")).where("`sum(volume)` <> 40").count() == 0 and v.select("day_index").distinct().count() == 30


def test_dead_letters(spark):
    rows = frame(spark, [(1.0,), (float("nan"),), (None,), (float("inf"),)], "v double")
    good, bad = dossier.dead_letters(rows, ["v"])
    assert good.count() == 1 and bad.count() == 3


def test_band_lookup_of_every_part(spark, tmp_path):
    from skyloom.plans import probes

    rng = np.random.default_rng(4)
    parts = [(i, float(p)) for i, p in enumerate(rng.integers(900, 1100, 120), 1)]
    orders = [(i, float(p)) for i, p in enumerate(rng.integers(17000, 23000, 150), 1)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for part, price in parts:
        near = [(-total, order) for order, total in orders if abs(total - price * 20) <= 500]
        if near:
            want[part] = min(near)[1]
    got = {r.p_partkey: r.o_orderkey for r in probes.QUERIES["band_lookup"](spark, str(tmp_path)).collect()}
    assert got == want and max(got) > 50


def test_band_lookup_counts_no_pairs(spark, tmp_path):
    """All bands hold all orders: rows between the steps stay few, equal keys and odd prices included."""
    from skyloom.plans import probes

    parts = [(i, 1000 + i / 100) for i in range(300)] + [(7, 990.0), (900, None), (901, float("nan")), (902, float("inf")), (903, -1000.0), (None, 1000.0)]
    orders = [(i, 20000 + i % 200.0) for i in range(600)] + [(700, None), (701, float("nan")), (702, float("inf")), (703, -20500.0), (704, -19500.0), (705, -19499.0)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = probes.QUERIES["band_lookup"](spark, str(tmp_path))
    want = {i: 199 for i in [*range(300), None]} | {901: 701, 902: 702, 903: 704}
    assert {r.p_partkey: r.o_orderkey for r in got.collect()} == want and got.count() == len(want)
    got.collect()
    plan, made = got._jdf.queryExecution().executedPlan(), []

    def visit(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        below = [node.plan()] if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        for child in below:
            visit(child)

    visit(plan)
    assert made and max(made) < 3 * (len(parts) + len(orders))


@pytest.mark.parametrize("tile", [3, 7, 2048])
@pytest.mark.parametrize("largest", [True, False])
def test_tiled_neighbours_against_all_pairs(spark, monkeypatch, tile, largest):
    monkeypatch.setattr(relation, "TILE", tile)
    rng = np.random.default_rng(tile)
    x = rng.integers(-2, 3, (40, 3)).astype(float)  # many ties
    rows = frame(spark, [(7 * i % 41, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vec array<double>")
    for drop in (False, True):
        got = {}
        for r in relation.k_nearest(rows, rows, 4, largest, drop).orderBy("src", "slot").collect():
            got.setdefault(r.src, []).append((r.dst, r.score))
        for i, v in enumerate(x):
            every = sorted(((7 * j % 41, float(v @ w)) for j, w in enumerate(x) if not (drop and i == j)), key=lambda p: (-p[1] if largest else p[1], p[0]))
            assert got[7 * i % 41] == every[:4]
        assert 99 not in got


def test_neighbours_beside_vectors_that_are_not_finite(spark, monkeypatch):
    monkeypatch.setattr(relation, "TILE", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 3))
    good = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    bad = frame(spark, [(20 + i, [float("nan"), 1.0, 1.0]) for i in range(5)] + [(30, [float("inf"), float("-inf"), 0.0])], "id long, vec array<double>")
    for largest in (True, False):
        want = sorted(map(tuple, relation.k_nearest(good, good, 2, largest).collect()))
        got = sorted(map(tuple, relation.k_nearest(good, good.union(bad.where("id < 30")), 2, largest).collect()))
        assert got == want and len(want) == 24
    assert relation.k_nearest(bad, good, 2).where("src < 30").count() == 0


def test_dead_codes_restart(spark):
    codes = frame(spark, [(0, 90.0, [1.0, 0.0]), (1, 0.1, [0.0, 1.0]), (2, 0.0, [2.0, 2.0]), (3, 9.9, [3.0, 3.0])], "code int, size double, vec array<double>")
    bank = frame(spark, [(i, [10.0 + i, 0.0]) for i in range(5)] + [(9, None)], "id long, vec array<double>")
    got = {r.code: (r.size, r.vec) for r in relation.reseeded_codes(codes, bank).collect()}
    assert got[0] == (90.0, [1.0, 0.0]) and got[3] == (9.9, [3.0, 3.0])
    assert got[1][0] == got[2][0] == 1.0 and got[1][1][0] >= 10 and got[2][1][0] >= 10 and got[1][1] != got[2][1]
    few = {r.code: r.size for r in relation.reseeded_codes(codes, bank.where("id = 2")).collect()}
    assert sorted(few.values()) == [0.0, 1.0, 9.9, 90.0]
