"""Latitude-longitude bucket cells: the engine's spatial key."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.calendar import col

STRIDE = 100000


def side_deg(resolution: int) -> float:
    return max(0.5, 20.0 / (resolution + 1))


def cell_of(lat_deg, lng_deg, resolution: int = 4) -> Column:
    s = side_deg(resolution)
    return (F.floor((col(lat_deg) + 90) / s) * STRIDE + F.floor((col(lng_deg) + 180) / s)).cast("long")


def parent_of(cell, resolution: int, coarser: int) -> Column:
    """The coarser cell that holds a cell's south-west corner."""
    s = side_deg(resolution)
    lat = F.floor(col(cell) / STRIDE) * s - 90
    lng = F.pmod(col(cell), F.lit(STRIDE)) * s - 180
    return cell_of(lat, lng, coarser)


def ring(cell, k: int = 1) -> Column:
    """The cells within k steps, rows off the map left out, columns not wrapped."""
    row, column = F.floor(col(cell) / STRIDE).cast("long"), F.pmod(col(cell), F.lit(STRIDE)).cast("long")
    near = F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda i: F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda j: F.struct((row + i).alias("r"), (column + j).alias("c"))))
    return F.transform(F.filter(F.flatten(near), lambda x: (x["r"] >= 0) & (x["c"] >= 0)), lambda x: x["r"] * STRIDE + x["c"])


def cover(min_lat: float, min_lng: float, max_lat: float, max_lng: float, resolution: int = 4) -> list[int]:
    """All cells that a box touches; a box with min_lng > max_lng crosses the antimeridian."""
    if min_lng > max_lng:
        return cover(min_lat, min_lng, max_lat, 180.0, resolution) + cover(min_lat, -180.0, max_lat, max_lng, resolution)
    s = side_deg(resolution)
    rows = range(math.floor((min_lat + 90) / s), math.floor((max_lat + 90) / s) + 1)
    columns = range(math.floor((min_lng + 180) / s), math.floor((max_lng + 180) / s) + 1)
    return [r * STRIDE + c for r in rows for c in columns]
