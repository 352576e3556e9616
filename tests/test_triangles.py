"""The icosphere by addresses against plain loops and against its definition by halved edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.sources import mesh, triangles as t


@pytest.mark.parametrize("levels", [0, 1, 2, 3, 4])
def test_nodes_are_those_of_halved_edges(spark, levels):
    got = t.node_points(spark, levels).collect()
    key = lambda p: tuple(round(c, 10) + 0.0 for c in p)
    assert [r.node for r in sorted(got)] == list(range(10 * 4**levels + 2))
    points = {key((r.x, r.y, r.z)) for r in got}
    assert len(points) == 10 * 4**levels + 2 and points == {key(p) for p in mesh.icosphere_points(levels)}
    assert mesh.icosphere(spark, levels).agg(F.countDistinct("node"), F.min("z")).first()[0] == len(points)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_neighbours_share_a_side(spark, levels):
    rows = t.triangles(spark, levels).select("*", t.triangle_neighbours(F.col("triangle"), levels).alias("near")).collect()
    key = lambda p: tuple(round(c, 9) + 0.0 for c in p)
    corners = {r.triangle: {key(r.a), key(r.b), key(r.c)} for r in rows}
    of = {}
    for name, own in corners.items():
        assert len(own) == 3
        for p in own:
            of.setdefault(p, set()).add(name)
    assert len(of) == 10 * 4**levels + 2
    for r in rows:
        beside = {n for p in corners[r.triangle] for n in of[p] if len(corners[n] & corners[r.triangle]) == 2}
        assert len(r.near) == 3 and set(r.near) == beside


def test_descent_finds_the_triangle(spark):
    levels, draw = 3, random.Random(3)
    places = [(i, draw.uniform(-89, 89), draw.uniform(-180, 180)) for i in range(400)]
    rows = spark.createDataFrame(places, "id long, lat double, lng double").select("id", t.triangle_of(F.col("lat"), F.col("lng"), levels).alias("at"), t.triangle_of(F.col("lat"), F.col("lng"), levels - 1).alias("parent"))
    sides = {r.triangle: np.array([r.a, r.b, r.c]) for r in t.triangles(spark, levels).collect()}
    names = np.array(sorted(sides))
    inverse = np.linalg.inv(np.array([sides[n] for n in names]).transpose(0, 2, 1))
    found = {r.id: (r.at, r.parent) for r in rows.collect()}
    for i, lat, lng in places:
        a, b = np.radians(lat), np.radians(lng)
        inside = (inverse @ np.array([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)]) > 0).all(axis=1)
        assert found[i] == (names[inside].item(), names[inside].item() >> 2)


def test_deep_levels_and_odd_places(spark):
    """A triangle of 28 halvings holds its point; nodes, poles and arcs have one triangle; what has no direction has none."""
    draw = random.Random(9)
    rows = spark.createDataFrame([(draw.uniform(-89, 89), draw.uniform(-180, 180)) for _ in range(20)], "lat double, lng double")
    at = rows.select("*", t.triangle_of(F.col("lat"), F.col("lng"), t.DEEPEST).alias("at"))
    near = at.select("*", t.triangle_corners(F.col("at"), t.DEEPEST).alias("c"), t.triangle_neighbours(F.col("at"), t.DEEPEST).alias("near"))
    back = near.select("*", F.array_contains(t.triangle_neighbours(F.col("near")[1], t.DEEPEST), F.col("at")).alias("mutual"))
    for r in back.collect():
        a, b = np.radians(r.lat), np.radians(r.lng)
        assert np.abs(np.array(r.c.a) - [np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)]).max() < 1e-7 and r.mutual
    odd = spark.createDataFrame([(0.0, 0.0), (90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)], "lat double, lng double")
    got = [r.at for r in odd.select(t.triangle_of(F.col("lat"), F.col("lng"), 2).alias("at")).collect()]
    assert all(0 <= g < 320 for g in got[:4]) and got[4:] == [None] * 3
    none = odd.select(t.triangle_corners(F.lit(None), 2).alias("c"), t.triangle_neighbours(F.lit(None), 2).alias("n"), t.triangle_at(F.lit(0), F.lit(0), F.lit(0), 2).alias("z")).first()
    assert tuple(none) == (None, None, None)
    with pytest.raises(ValueError):
        t.node_points(spark, t.DEEPEST + 1)
