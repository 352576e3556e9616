import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import cli
from skyloom.functions import angles, features
from skyloom.functions.angles import great_circle_deg
from skyloom.operators import transducer as td
from skyloom.plans import registry


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


def array(x):
    return F.array(*[array(v) if isinstance(v, (list, np.ndarray)) else F.lit(float(v)) for v in x])


def test_chords_against_numpy(value):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(5, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.triu_indices(5, 1)
    dots = (v[i] * v[j]).sum(1)
    gate = 1 / (1 + np.exp(-8 * v[:, 2]))
    assert value(features.chords(array(v), 5)) == pytest.approx(dots.tolist())
    assert value(features.gated_chords(array(v), 5)) == pytest.approx((dots * gate[i] * gate[j]).tolist())
    assert len(value(features.target(array(v), 5))) == 25


def test_metrics(value):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=9), rng.normal(size=9)
    want = np.linalg.norm((a - b)[:6]) / 6**0.5 + np.linalg.norm((a - b)[6:]) / 3**0.5
    assert value(features.sky_distance(array(a), array(b), 6)) == pytest.approx(want)
    assert value(features.isometric_error(array([1, 0]), array([0, 0]), F.lit(2.0), 0.5)) == pytest.approx(0)
    same = array([0.6, 0.0, 0.8, 1.0, 0.0])
    assert value(features.geodesic_error(same, same)) < 1e-3
    lons = np.array([0.1, 1.0, 2.5])
    assert value(features.aspect_error(array(lons), array(lons + 0.7), 3)) == pytest.approx(0, abs=1e-12)
    assert value(features.aspect_error(array(lons), array(lons * 1.1), 3)) > 0


def test_vectors(value):
    v = features.state_vector(F.lit(0.3), F.lit(0.1), F.lit(2.0), F.lit(0.01), F.lit(0.0), F.lit(0.0))
    assert value(features.decode_direction(v)) == (pytest.approx(0.3), pytest.approx(0.1))
    far = value(F.degrees(features.elongation(F.lit(0.3), F.lit(0.1), F.lit(1.0), F.lit(0.0))))
    assert far == pytest.approx(value(great_circle_deg(F.lit(0.1), F.lit(0.3), F.lit(0.0), F.lit(1.0))))
    assert len(value(features.observer_row(F.lit(0.1), F.lit(0.2), F.lit(0.3)))) == 8
    assert len(value(features.interference(array([0.1, 0.2, 0.3]), 3))) == 15


def test_spectrum_round_trip(value):
    assert np.allclose(td.band_basis() @ td.band_basis().T, np.eye(4))
    e = {"micro": 0.3, "fast": 0.9, "cyclic": 0.2, "macro": 0.6}
    got = td.recover(td.emit({b: F.lit(x) for b, x in e.items()}))
    assert {b: value(c) for b, c in got.items()} == pytest.approx(e, abs=1e-9)


def test_relief_round_trip(spark):
    basis, w = td.sphere()
    assert np.allclose((basis * w) @ basis.T, np.eye(64), atol=1e-10) and w.sum() == pytest.approx(4 * math.pi)
    z = np.random.default_rng(2).normal(size=(3, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id int, latent array<double>")
    back = td.analyze(td.synthesize(df).select("id", "relief")).orderBy("id").collect()
    assert np.allclose([r.latent for r in back], z, atol=1e-8)


def test_fields(spark):
    rng = np.random.default_rng(3)
    d, c = rng.normal(size=(2, 25, 25))
    d, c = d - d.mean(), c - c.mean()
    u, v = td.field_of(d, c)
    assert np.allclose(td.div_curl(u, v), (d, c), atol=1e-6)
    parts = td.hodge(u + 2, v - 1)
    assert np.allclose(parts["u_gradient"] + parts["u_rotation"] + 2, u + 2)
    assert np.allclose(td.div_curl(parts["u_rotation"], parts["v_rotation"])[0], 0, atol=1e-8)
    assert np.allclose(td.div_curl(parts["u_gradient"], parts["v_gradient"])[1], 0, atol=1e-8)
    rows = spark.createDataFrame([(0, u.ravel().tolist(), v.ravel().tolist())], "id long, u array<double>, v array<double>")
    assert np.allclose(td.hodge_frames(rows, 25, 25).first().div, d.ravel(), atol=1e-6)


def test_streaks_follow_the_field():
    noise = np.random.default_rng(4).normal(size=(32, 32))
    out = td.streaks(np.ones((32, 32)), np.zeros((32, 32)), noise)
    along, across = np.abs(np.diff(out, axis=1)).mean(), np.abs(np.diff(out, axis=0)).mean()
    assert along < across / 3


def test_sql_names(spark):
    registry.register(spark)
    row = spark.sql("SELECT frame_to_jd(3600L) AS a, jd_to_frame(588466.5D) AS b, leaf_of(10, 7) AS c, separation_deg(0D, 200D) AS d, sign_of(-1D) AS e, token_rarity(1L, 10000L) AS f").first()
    assert (row.a, row.b, row.c, row.d, row.e) == (588466.5, 3600, 647, 160.0, 11) and row.f > 0.9
    assert spark.sql("SELECT * FROM gen_mesh(1)").count() == 42
    assert spark.sql("SELECT t.v, f.jd FROM VALUES (0), (5) t(v), LATERAL gen_frames(t.v, t.v + 2) f").count() == 4
    assert spark.sql("SELECT * FROM bbox_cells(10.0D, -20.0D, 45.9D, 27.9D)").count() == 108


def test_command_line(spark, capsys):
    cli.main(["reading", "2024-04-08T18:17:00Z"])
    cli.main(["scan", "2024-04-01", "2024-04-12", "--top", "2"])
    cli.main(["map", "2024-04-08", "--nodes", "20"])
    out = capsys.readouterr().out.strip().splitlines()
    assert len(out) == 1 + 2 + 20 and '"is_eclipse":true' in out[0]


def test_fourier_keeps_the_order_of_components(spark):
    row = spark.range(1).select(features.fourier(F.array(F.lit(0.5), F.lit(0.25)), 1).alias("f"), features.fourier(F.array(F.lit(0.5)), 2, raw=False).alias("g"), features.fourier(F.array(F.lit(2.0)), 0).alias("h")).first()
    assert [round(x, 6) for x in row.f] == [0.5, 1.0, 0.0, 0.25, round(0.5**0.5, 6), round(0.5**0.5, 6)]
    assert [round(x, 6) for x in row.g] == [1.0, 0.0, 0.0, -1.0] and row.h == [2.0]


def test_the_vertex_is_in_the_west(spark):
    """It lies on the ecliptic and on the prime vertical: its azimuth is due west."""

    eps, lat = math.radians(23.44), math.radians(48.0)
    for ramc in (0.3, 1.9, 3.3, 5.0):
        lon = spark.range(1).select(angles.vertex(ramc, eps, lat)).first()[0]
        ra, dec = math.atan2(math.sin(lon) * math.cos(eps), math.cos(lon)), math.asin(math.sin(eps) * math.sin(lon))
        h = ramc - ra
        north = math.sin(dec) * math.cos(lat) - math.cos(dec) * math.sin(lat) * math.cos(h)
        east = -math.cos(dec) * math.sin(h)
        assert abs(north) < 1e-9 and east < 0
