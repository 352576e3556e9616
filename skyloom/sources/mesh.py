"""Observer meshes: Fibonacci lattice, icosphere, equirectangular and regional grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.cells import cell_of
from skyloom.sources.triangles import node_points

EARTH_KM = 6371.0


def _with_geometry(df: DataFrame) -> DataFrame:
    """lat, lon (radians) -> also x, y, z, degrees and cell."""
    return df.select(
        "node", "lat", "lon",
        (F.cos("lat") * F.cos("lon")).alias("x"), (F.cos("lat") * F.sin("lon")).alias("y"), F.sin("lat").alias("z"),
        F.degrees("lat").alias("lat_deg"), F.degrees("lon").alias("lng_deg"),
        cell_of(F.degrees("lat"), F.degrees("lon")).alias("cell"),
    )


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """Exactly n nodes of nearly equal area."""
    golden = math.pi * (3 - math.sqrt(5))
    z = 1 - 2 * (F.col("id") + 0.5) / n
    lon = F.pmod(F.col("id") * golden + math.pi, F.lit(2 * math.pi)) - math.pi
    return _with_geometry(spark.range(n).select(F.col("id").cast("int").alias("node"), F.asin(z).alias("lat"), lon.alias("lon")))


def icosphere_points(levels: int) -> list[tuple[float, float, float]]:
    """10 * 4**levels + 2 unit vectors: an icosahedron whose edges are halved ``levels`` times."""
    up = (1 + math.sqrt(5)) / 2
    unit = lambda p: tuple(c / math.sqrt(sum(x * x for x in p)) for c in p)
    points = [unit(p) for a in (-1.0, 1.0) for b in (-up, up) for p in ((0.0, a, b), (a, b, 0.0), (b, 0.0, a))]
    near = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    edge = min(near(points[0], q) for q in points[1:]) * 1.01
    faces = [
        (i, j, k)
        for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12)
        if max(near(points[i], points[j]), near(points[j], points[k]), near(points[i], points[k])) < edge
    ]
    for _ in range(levels):
        middle: dict[tuple[int, int], int] = {}

        def between(i: int, j: int) -> int:
            key = (min(i, j), max(i, j))
            if key not in middle:
                middle[key] = len(points)
                points.append(unit(tuple(a + b for a, b in zip(points[i], points[j], strict=True))))
            return middle[key]

        split = []
        for i, j, k in faces:
            a, b, c = between(i, j), between(j, k), between(k, i)
            split += [(i, a, c), (a, j, b), (c, b, k), (a, b, c)]
        faces = split
    return points


def icosphere(spark: SparkSession, levels: int) -> DataFrame:
    """The same points, each made from its number in Spark; nodes are numbered as in ``triangles``."""
    lat, lon = F.asin(F.least(F.greatest("z", F.lit(-1.0)), F.lit(1.0))), F.atan2("y", "x")
    return _with_geometry(node_points(spark, levels).select("node", lat.alias("lat"), lon.alias("lon")))


def equirectangular(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Cell centres of a latitude-longitude raster, north first."""
    r, c = F.floor(F.col("id") / columns), F.col("id") % columns
    lat, lon = 90 - (r + 0.5) * 180 / rows, -180 + (c + 0.5) * 360 / columns
    return _with_geometry(spark.range(rows * columns).select(F.col("id").cast("int").alias("node"), F.radians(lat).alias("lat"), F.radians(lon).alias("lon")))


def microgrid(spark: SparkSession, min_lat: float, min_lng: float, max_lat: float, max_lng: float, density: int) -> DataFrame:
    """density x density nodes over a box, edges included."""
    if density < 2 or min_lat >= max_lat or min_lng >= max_lng:
        raise ValueError("a micro-grid needs density >= 2 and a box with min < max")
    i, j = F.floor(F.col("id") / density), F.col("id") % density
    lat = min_lat + (max_lat - min_lat) * i / (density - 1)
    lng = min_lng + (max_lng - min_lng) * j / (density - 1)
    return _with_geometry(spark.range(density * density).select(F.col("id").cast("int").alias("node"), F.radians(lat).alias("lat"), F.radians(lng).alias("lon")))


def spacing_km(min_lat: float, min_lng: float, max_lat: float, max_lng: float, density: int) -> tuple[float, float]:
    """North-south and east-west distance of a micro-grid's nodes, the latter at its middle latitude."""
    per_degree = math.pi / 180 * EARTH_KM
    middle = math.cos(math.radians((min_lat + max_lat) / 2))
    return (max_lat - min_lat) / (density - 1) * per_degree, (max_lng - min_lng) / (density - 1) * per_degree * middle


def random_points(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Points of uniform density by area."""
    lat, lon = F.asin(2 * F.rand(seed) - 1), (F.rand(seed + 1) * 2 - 1) * math.pi
    return _with_geometry(spark.range(n).select(F.col("id").cast("int").alias("node"), lat.alias("lat"), lon.alias("lon")))


def keep_first(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key, in a given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def rings(geojson: DataFrame) -> DataFrame:
    """Segments (feature, ring, position, from, to) of polygons: features with id and coordinates array<array<array<double>>>."""
    ring = geojson.select("id", F.posexplode("coordinates").alias("ring", "points"))
    point = ring.select("id", "ring", F.posexplode("points").alias("position", "point"))
    after = F.lead("point").over(Window.partitionBy("id", "ring").orderBy("position"))
    return point.withColumn("to", after).where("to is not null").withColumnRenamed("point", "from")
