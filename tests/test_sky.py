"""Ephemeris, mesh, projection, weather and twin search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import api
from skyloom.functions.zodiac import BODIES
from skyloom.operators import kernels, sky, twin, weather
from skyloom.sources import mesh
from skyloom.sources.ephemeris import BODIES as ENTITIES
from skyloom.sources.ephemeris import global_state
from skyloom.sources.frames import blocks, chunks, frames
from skyloom.sources.positions import positions

ECLIPSE = 2460409.26181  # 2024-04-08


@pytest.fixture(scope="module")
def rows(spark):
    return api.instants(spark, 2451545.0, ECLIPSE, ECLIPSE + 1 / 24).cache()


def test_known_positions(rows):
    lon = {r.body: math.degrees(r.lon) for r in rows.where("jd = 2451545").collect()}
    for body, want, tolerance in (("Sun", 280.37, 0.1), ("Moon", 223.3, 0.6), ("Mars", 327.96, 0.2), ("Jupiter", 25.25, 0.3), ("Saturn", 40.4, 0.3), ("Rahu", 125.04, 0.1)):
        assert abs((lon[body] - want + 180) % 360 - 180) < tolerance, body


def test_directions_are_unit_vectors_and_match_numpy(rows):
    for jd in (2451545.0, ECLIPSE):
        got = np.array([[r.x, r.y, r.z] for r in rows.where(F.col("jd") == jd).orderBy("body_id").collect()])
        assert np.allclose((got**2).sum(1), 1) and np.allclose(got, sky.directions(jd), atol=1e-9)


def test_rates(rows):
    rate = {r.body: math.degrees(r.lon_rate) for r in rows.where("jd = 2451545").collect()}
    assert rate["Sun"] == pytest.approx(1.019, abs=0.01) and 11 < rate["Moon"] < 15.5 and rate["Rahu"] == pytest.approx(-0.05295, abs=1e-4)


def test_eclipse_of_2024(rows):
    got = {round(r.jd, 5): r for r in weather.signatures(rows).collect()}
    assert got[round(ECLIPSE, 5)].is_eclipse and got[round(ECLIPSE, 5)].solar > 0.9
    assert not got[2451545.0].is_eclipse


def test_pairs_against_plain_loops(rows):
    lons = [r.lon for r in rows.where("jd = 2451545").orderBy("body_id").collect()]
    from skyloom.functions import aspects as A

    want = [0.0, 0.0]
    for i in range(10):
        for j in range(i + 1, 10):
            d = abs(math.degrees(lons[i]) - math.degrees(lons[j])) % 360
            d = min(d, 360 - d)
            for k, kind in enumerate((A.CONSTRUCTIVE, A.DESTRUCTIVE)):
                want[k] += A.WEIGHTS[i] * A.WEIGHTS[j] * sum(math.exp(-0.5 * ((d - a) / 6) ** 2) for a in kind.values())
    got = weather.aspect_field(weather.pairs(rows)).where("jd = 2451545").first()
    assert (got.resonance, got.tension) == (pytest.approx(want[0]), pytest.approx(want[1]))
    assert weather.activation(weather.pairs(rows)).where("jd = 2451545").agg(F.sum("activation")).first()[0] == pytest.approx(2 * sum(want))
    top = weather.dominant_aspects(weather.pairs(rows)).where("jd = 2451545").orderBy("rank").collect()
    assert 0 < len(top) <= 5 and [r.strength for r in top] == sorted((r.strength for r in top), reverse=True)


def test_temporal_shear_against_numpy(spark):
    step = 1 / 24
    rows = global_state(spark.createDataFrame([(2451545.0 + i * step,) for i in range(6)], "jd double"))
    got = weather.temporal_shear(weather.signatures(rows), step).orderBy("jd").collect()
    v = np.array([[r.resonance, r.tension, r.concentration] for r in got])
    want = np.linalg.norm(v[2:] - v[:-2], axis=1) / (2 * step)
    assert [r.shear for r in got[1:-1]] == pytest.approx(want.tolist()) and got[0].shear is None and got[-1].shear is None


def test_projection_invariants(spark, rows):
    field = weather.project(rows, mesh.fibonacci(spark, 120))
    bad = field.where(
        (F.abs(F.col("north") ** 2 + F.col("east") ** 2 + F.col("up") ** 2 - 1) > 1e-9) | (F.abs(F.col("cos_asc") ** 2 + F.col("sin_asc") ** 2 - 1) > 1e-9) | (F.abs("up") > 1)
    )
    assert field.count() == 3 * 120 * 10 and bad.count() == 0


def test_heat_map(spark):
    got = api.heatmap(spark, ECLIPSE, mesh.fibonacci(spark, 60)).collect()
    assert len(got) == 60 and all(r.potential > 0 and r.shear >= 0 for r in got)


def test_meshes(spark):
    assert mesh.fibonacci(spark, 77).count() == 77
    for k in (0, 1, 2):
        points = mesh.icosphere_points(k)
        assert len(points) == 10 * 4**k + 2 == len({tuple(round(c, 9) for c in p) for p in points})
        assert np.allclose((np.array(points) ** 2).sum(1), 1)
    assert mesh.microgrid(spark, 0, 0, 10, 20, 5).agg(F.max("lat_deg"), F.max("lng_deg")).first() == (pytest.approx(10), pytest.approx(20))
    with pytest.raises(ValueError):
        mesh.microgrid(spark, 0, 0, 10, 20, 1)
    assert mesh.equirectangular(spark, 4, 8).count() == 32 and mesh.spacing_km(0, 0, 10, 10, 11)[0] == pytest.approx(111.19, abs=0.1)
    twice = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "name string, pos int")
    assert {tuple(r) for r in mesh.keep_first(twice, "name", F.col("pos")).collect()} == {("a", 1), ("b", 3)}


def test_rings(spark):
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    got = mesh.rings(spark.createDataFrame([(1, square)], "id int, coordinates array<array<array<double>>>"))
    assert got.count() == 3 and got.orderBy("position").first().to == [1.0, 0.0]


def test_frames_and_chunks(spark):
    assert frames(spark, 0, 10).agg(F.max("jd")).first()[0] == pytest.approx(588465.5 + 9 * 24 / 86400)
    assert [tuple(r) for r in chunks(spark, 10, 4).orderBy("start").collect()] == [(0, 4), (4, 8), (8, 10)]
    with pytest.raises(ValueError):
        chunks(spark, 0, 4)
    assert [tuple(r) for r in blocks(spark, 590, 1210).orderBy("start").collect()] == [(0, 599), (600, 1199), (1200, 1799)]


@pytest.fixture(scope="module")
def table(spark):
    return positions(spark, 2446067.0, 2449719.0).cache()


@pytest.fixture(scope="module")
def natal(spark):
    return twin.natal_key(spark, 2447893.0, 26.9, 75.8)


def test_positions(table):
    row = table.agg(*[F.max(f"{b}_sign") for b in BODIES], *[F.max(f"{b}_nak") for b in BODIES], *[F.max(f"{b}_deg") for b in BODIES]).first()
    assert table.count() == 3653 and max(row[:9]) <= 11 and max(row[9:18]) <= 26 and max(row[18:]) < 30


def test_twin_tiers_on_the_natal_day(spark, table, natal):
    flags = twin.available(table, natal).first()
    assert all(flags[f"tier_{t}"] for t in twin.TIERS)
    counts = {t: table.where(twin.tier_condition(natal, t, list(BODIES))).count() for t in twin.TIERS}
    assert counts[1] >= counts[2] == counts[4] >= counts[5] >= counts[6] >= 1 and counts[3] >= counts[2] and counts[7] >= counts[8]
    one = twin.search(table, natal, 2, first_year=1990, last_year=1990).first()
    assert one.total_matched == 9 and one.match_score == 1.0 and one.location_free


def test_relaxing_never_loses_days(table, natal):
    for t in twin.TIERS:
        few = table.where(twin.tier_condition(natal, t, ["sun", "saturn"]))
        assert few.count() >= table.where(twin.tier_condition(natal, t, list(BODIES))).count()
    assert twin.search(table, natal, 2, bodies=[]).count() == 0
    residents = {b for b, v in natal["bodies"].items() if v["house"] in (1, 5)}
    assert set(twin.active_bodies(natal, houses=[1, 5])) == residents


def test_longitudes_put_the_ascendant_in_its_sign(spark, table, natal):
    found = twin.with_places(twin.search(table, natal, 3, limit=5), natal, 3, 26.9).collect()
    assert found and all(-180 <= r.lon <= 180 and r.local_time.endswith("LMT") for r in found)
    for r in found:
        sign = spark.range(1).select(F.floor(twin.ascendant_sidereal(F.lit(r.jd), F.lit(26.9), F.lit(r.lon)) / 30)).first()[0]
        assert sign == natal["ascendant_sign"]
    sharp = twin.with_places(twin.search(table, natal, 8, limit=3), natal, 8, 26.9).collect()
    assert sharp and all(len(r.globe_points) > 0 for r in sharp)


def test_adaptive_clock(spark):
    ticks = list(kernels.walk(0.0, 1.0, lambda t: np.array([[math.sin(t), math.cos(t), 0.0]]), 0.25, 0.05, 10.0, 100))
    assert [t[0] for t in ticks] == [0.0, 0.25, 0.5, 0.75, 1.0] and not any(t[1] for t in ticks)
    fast = list(kernels.walk(0.0, 1.0, lambda t: np.array([[t, 0.0, 0.0]]), 0.25, 0.05, 0.01, 100))
    assert sum(t[1] for t in fast) >= 20 and fast[-1][0] == pytest.approx(1.0)
    segments = spark.createDataFrame([(0, 2451545.0, 2451545.25), (1, 2451545.25, 2451545.5)], "segment long, start double, end double")
    got = kernels.adaptive_ticks(segments, threshold=0.02).groupBy("segment").agg(F.min("jd"), F.max("jd"), F.count("*")).collect()
    assert {r[0]: r[2] for r in got} == {0: 2451545.25, 1: 2451545.5}


def test_news_and_subsolar(rows):
    card = weather.news_card(rows).where("jd = 2451545").first()
    assert len(card.bodies) == 9 and card.applying in (True, False)
    sun = weather.subsolar(rows).where("jd = 2451545").first()
    assert math.degrees(sun.lat) == pytest.approx(-23.03, abs=0.1) and abs(math.degrees(sun.lon)) < 2
    assert len(ENTITIES) == 10


def test_velocity_is_dominated_by_the_moon(spark):
    rows = global_state(spark.createDataFrame([(2451545.0 + i / 24,) for i in range(3)], "jd double"))
    assert all(0.005 < r.velocity < 0.02 for r in weather.velocity(rows).collect())


def test_skies_in_place_equal_pairs(spark):
    """What is made from the array of an instant is what its exploded pairs give, nulls included, and moves no rows."""
    rng = np.random.default_rng(6)
    lons = [[float(x) for x in rng.uniform(0, 2 * math.pi, 10)] for _ in range(60)]
    lons[3][4], lons[5], lons[7][1:] = None, [None] * 10, [None] * 9
    sky = spark.createDataFrame(list(enumerate(lons)), "k long, lons array<double>")
    pair = weather.pairs(sky, "k")
    rows = lambda df, *by: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.orderBy("k", *by).collect()]
    assert rows(weather.aspect_field(sky, "k")) == rows(weather.aspect_field(pair, "k"))
    assert rows(weather.activation(sky, "k"), "body_id") == rows(weather.activation(pair, "k"), "body_id")
    assert rows(weather.band_energies(sky, "k"), "band") == rows(weather.band_energies(weather.activation(pair, "k"), "k"), "band")
    assert rows(weather.dominant_aspects(sky, "k"), "rank") == rows(weather.dominant_aspects(pair, "k"), "rank")
    long = sky.selectExpr("k", "posexplode(lons) AS (body_id, lon)")
    assert rows(weather.signatures(sky, "k")) == rows(weather.signatures(long, "k"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for made in (weather.aspect_field, weather.activation, weather.band_energies, weather.dominant_aspects, weather.signatures):
        assert "Exchange" not in plan(made(sky, "k"))


def test_shear_across_blocks_of_the_axis(spark, monkeypatch):
    monkeypatch.setattr(weather, "AXIS_BLOCK", 4)
    at = [-9, -8, -5, -4, -3, -1, 0, 1, 3, 4, 5, 7, 8, 12]
    rows = spark.createDataFrame([(i, float(i * i % 17), 0.0, None if i == 4 else 0.0) for i in at], "k long, resonance double, tension double, concentration double")
    made = weather.temporal_shear(rows, 1.0, "k")
    want = {i: abs((i + 1) ** 2 % 17 - (i - 1) ** 2 % 17) / 2 if {i - 1, i + 1} <= set(at) and 4 not in (i - 1, i + 1) else None for i in at}
    assert {r.k: r.shear for r in made.collect()} == want
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
