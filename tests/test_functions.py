import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions import angles, aspects, calendar, cells, light, tokens, zodiac


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,jd",
    [
        ("2000-01-01T12:00:00Z", 2451545.0),
        ("2024-04-08T18:17:00Z", 2460409.26181),
        ("2000-01-01", 2451544.5),
        ("2000-01-01T14:00:00+02:00", 2451545.0),
        ("-3101-02-18T00:00:00", 588491.5),
        ("0000-03-01", 1721119.5),
        ("nonsense", None),
    ],
)
def test_dates_to_julian_days(value, text, jd):
    got = value(calendar.parse_datetime(F.lit(text)))
    assert got is None if jd is None else got == pytest.approx(jd, abs=1e-5)


def test_calendar_round_trip(spark):
    jd = (F.col("id") * 9973 + 0.25).cast("double")
    g = calendar.jd_to_gregorian(jd)
    back = calendar.gregorian_to_jd(g["year"], g["month"], g["day"], g["hour"], g["minute"], g["second"])
    assert spark.range(400).where(F.abs(back - jd) > 1e-6).count() == 0


def test_texts_of_dates(value):
    assert value(calendar.date_text(calendar.parse_datetime(F.lit("0000-05-06")))) == "0001-05-06 BCE"
    assert value(calendar.date_text(F.lit(2451545.0))) == "2000-01-01 CE"
    assert value(calendar.time_text(F.lit(2451545.0))) == "12:00 UTC"
    assert value(calendar.local_mean_time_text(F.lit(2451545.0), F.lit(75.0))) == "17:00 LMT"
    assert value(calendar.jd_or_datetime(F.lit("2451545.5"))) == 2451545.5
    assert value(calendar.local_to_jd(F.lit("1990-01-01"), F.lit("12:00"), F.lit(5.5))) == pytest.approx(2447893.0 - 5.5 / 24)


def test_frames(value):
    assert value(calendar.jd_to_frame(calendar.frame_to_jd(F.lit(12345678)))) == 12345678
    assert value(calendar.century_of(F.lit(2451545.0))) == 20
    assert value(calendar.century_of(calendar.parse_datetime(F.lit("-0001-01-01")))) == -1


@pytest.mark.parametrize("x,want", [(0.0, 0.0), (math.pi, -math.pi), (-math.pi, -math.pi), (7.0, 7 - 2 * math.pi)])
def test_wrapping(value, x, want):
    assert value(angles.wrap_angle(F.lit(x))) == pytest.approx(want)


def test_separations_and_circles(value):
    assert value(angles.separation_deg(F.lit(0.0), F.lit(200.0))) == 160
    assert value(angles.interpolate_angle(F.lit(350.0), F.lit(10.0), F.lit(0.5))) == pytest.approx(360)
    assert value(angles.great_circle_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(math.pi))) == pytest.approx(180)
    assert value(angles.haversine_deg(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0))) == 0
    step = value(angles.step_along(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2), F.lit(0.1)))
    assert (step["lat"], step["lon"]) == (pytest.approx(0, abs=1e-12), pytest.approx(0.1))
    v = angles.unit_vector(F.lit(0.3), F.lit(-0.2))
    assert value(angles.norm(v)) == pytest.approx(1) and value(angles.geodesic_distance(v, v)) < 1e-3


def test_sidereal_time_and_obliquity(value):
    assert value(angles.gmst_deg(F.lit(2451545.0))) == pytest.approx(280.46061837)
    assert value(F.degrees(angles.obliquity(F.lit(2451545.0)))) == pytest.approx(23.439291)
    assert value(angles.polar_fade(F.lit(45.0))) == 1 and value(angles.polar_fade(F.lit(89.0))) == pytest.approx(0)


def test_tokens(spark):
    leaf = tokens.leaf_of(F.lit(10), F.lit(7))
    assert spark.range(1).select(leaf, tokens.macro_of(leaf), tokens.micro_of(leaf)).first() == (647, 10, 7)


@pytest.mark.parametrize("count,total,low,high", [(9999, 10000, 0, 0.1), (1, 10000, 0.9, 1), (None, 10000, 0.99, 1), (0, 0, 0.99, 1)])
def test_rarity(value, count, total, low, high):
    assert low <= value(tokens.rarity(F.lit(count).cast("long"), F.lit(total))) <= high


def test_cells(spark, value):
    got = cells.cover(10.0, 170.0, 20.0, -170.0)
    assert value(cells.cell_of(F.lit(15.0), F.lit(179.9))) in got and value(cells.cell_of(F.lit(15.0), F.lit(-179.9))) in got
    wide = set(cells.cover(-60, -120, 60, 120))
    inside = spark.range(5000).select(cells.cell_of(F.rand(1) * 120 - 60, F.rand(2) * 240 - 120).alias("c")).distinct()
    assert {r.c for r in inside.collect()} <= wide
    assert len(value(cells.ring(F.lit(2200045), 1))) == 9
    assert value(cells.parent_of(cells.cell_of(F.lit(10.0), F.lit(10.0), 7), 7, 4)) == value(cells.cell_of(F.lit(10.0), F.lit(10.0), 4))


@pytest.mark.parametrize("lon,nav", [(0.1, 0), (30.1, 9), (60.1, 6), (119.99, 11)])
def test_navamsa(value, lon, nav):
    assert value(zodiac.navamsa_of(F.lit(lon))) == nav


def test_zodiac(value):
    assert value(zodiac.nakshatra_of(F.lit(359.9))) == 26 and value(zodiac.sign_of(F.lit(-0.5))) == 11
    assert value(zodiac.house_of(F.lit(2), F.lit(5))) == 10


def test_eclipses_and_applying(value):
    e = lambda s, m, n: value(aspects.eclipse(F.lit(s), F.lit(m), F.lit(n)))
    assert e(10.0, 10.0, 10.0)["solar"] == 1 and e(0.0, 180.0, 0.0)["lunar"] == 1 and not e(0.0, 0.0, 90.0)["is_eclipse"]
    assert value(aspects.is_applying(F.lit(10.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0))) is True
    both = [value(aspects.is_closing(F.lit(a), F.lit(b), F.lit(u), F.lit(v))) for a, b, u, v in ((10.0, 0.0, -1.0, 0.0), (0.0, 10.0, 0.0, -1.0))]
    assert both == [True, True]


def test_bands(value):
    gains = value(aspects.band_gains(F.lit(3600.0)))
    assert gains["micro"] < gains["fast"] < gains["cyclic"] < gains["macro"] <= 1
    assert value(aspects.temporal_stride(F.lit(2500))) == 3 and value(aspects.temporal_stride(F.lit(10))) == 1
    assert value(aspects.significance_percentile(F.lit(0.1))) == 95 and value(aspects.significance_percentile(F.lit(1e9))) == pytest.approx(99.99)


def test_light(value):
    assert value(light.naka_rushton_inverse(light.naka_rushton(F.lit(4.2)))) == pytest.approx(4.2)
    assert value(light.temperature_to_rarity(light.rarity_to_temperature(F.lit(0.73)))) == pytest.approx(0.73)
    xy = light.planckian_xy(F.lit(6500.0))
    assert value(light.correlated_temperature(xy["x"], xy["y"])) == pytest.approx(6500, rel=0.02)
    assert value(light.oklab_to_srgb8(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))) == [255, 255, 255]
    assert value(light.oklab_to_srgb8(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))) == [0, 0, 0]
    assert value(light.blackbody(F.lit(500.0), F.lit(6000.0))) > value(light.blackbody(F.lit(500.0), F.lit(3000.0)))
