"""Viewport queries: time range, region and threshold, strongest rows first, from the tier that fits the span."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.calendar import century_of
from skyloom.functions.cells import cover, side_deg

# Routing bounds in frames, and the cell lists that are still written out.
POINTS, HOURLY, DAILY = 1000, 150, 3600
MAX_CELLS = 4000
MAX_LIMIT = 10000


@dataclass(frozen=True)
class Viewport:
    start: float
    end: float
    min_lat: float = -90.0
    min_lng: float = -180.0
    max_lat: float = 90.0
    max_lng: float = 180.0
    rarity_min: float = 0.0
    limit: int = 1000
    velocity: float = 1.0

    def __post_init__(self):
        if self.end < self.start or self.min_lat > self.max_lat:
            raise ValueError("a viewport needs start <= end and min_lat <= max_lat")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"the limit must be 1 to {MAX_LIMIT}")


def tier_for(span_days: float, velocity: float = 1.0) -> str:
    frames = int(max(1, int(span_days * DAILY)) / max(velocity, 1.0))
    return "tier1" if frames <= POINTS else "tier2" if frames <= POINTS * HOURLY else "tier3"


def tier_column(span_days: Column, velocity: Column) -> Column:
    """``tier_for`` of columns."""
    whole = F.greatest(F.lit(1), F.floor(span_days * DAILY))
    frames = F.floor(whole / F.greatest(velocity, F.lit(1.0)))
    return F.when(frames <= POINTS, "tier1").when(frames <= POINTS * HOURLY, "tier2").otherwise("tier3")


def route(span_days: float, velocity: float, present: set[str]) -> str:
    """The tier that fits, or the next finer one that exists, or the finest coarser one."""
    order = ["tier1", "tier2", "tier3"]
    at = order.index(tier_for(span_days, velocity))
    for name in [*reversed(order[: at + 1]), *order[at + 1 :]]:
        if name in present:
            return name
    raise ValueError("the store holds no tier")


def in_region(v: Viewport, resolution: int = 4, cell: str = "h3") -> Column:
    """Membership in the region's cells if they are few, else plain bounds; across the antimeridian, two of either.

    Cells are taken whole, so up to ``MAX_CELLS`` of them a viewport also has the rows of its border cells that lie outside its bounds; this is the rule of the store's queries.
    """
    cells = cover(v.min_lat, v.min_lng, v.max_lat, v.max_lng, resolution)
    if len(cells) <= MAX_CELLS:
        return F.col(cell).isin(cells)
    lat = F.col("lat").between(v.min_lat, v.max_lat)
    if v.min_lng > v.max_lng:
        return lat & ((F.col("lng") >= v.min_lng) | (F.col("lng") <= v.max_lng))
    return lat & F.col("lng").between(v.min_lng, v.max_lng)


def predicate(v: Viewport, centuries: tuple[int, int], **region) -> Column:
    """All conditions; the centuries prune partitions, as bounds on the day alone would not."""
    return reduce(
        lambda a, b: a & b,
        [F.col("century").between(*centuries), F.col("jd").between(v.start, v.end), F.col("rarity") >= v.rarity_min, in_region(v, **region)],
    )


def near_bounds(v: Viewport, resolution: int = 4) -> Column:
    """Bounds that every row of the region keeps, border cells included; files are skipped by them. Rows without a place pass."""
    s = side_deg(resolution)
    out = F.col("lat").isNull() | F.col("lat").between(v.min_lat - s, v.max_lat + s)
    if v.min_lng > v.max_lng:
        out &= F.col("lng").isNull() | (F.col("lng") >= v.min_lng - s) | (F.col("lng") <= v.max_lng + s)
    elif v.min_lng - s >= -180 and v.max_lng + s <= 180:
        out &= F.col("lng").isNull() | F.col("lng").between(v.min_lng - s, v.max_lng + s)
    return out


def year_of(jd: float) -> int:
    """The proleptic Gregorian year of a Julian Day, on the driver."""
    z = int((jd + 0.5) // 1) + 32044
    b = (4 * z + 3) // 146097
    c = z - 146097 * b // 4
    d = (4 * c + 3) // 1461
    e = c - 1461 * d // 4
    return 100 * b + d - 4800 + ((5 * e + 2) // 153) // 10


def centuries(v: Viewport) -> tuple[int, int]:
    """The first and last century that a viewport touches."""
    return year_of(v.start) // 100, year_of(v.end) // 100


def viewport(tier: DataFrame, v: Viewport, **region) -> DataFrame:
    """The rarest rows of a region and time, ties by jd and node; only the tier's own columns that are there."""
    rows = tier.where(predicate(v, centuries(v), **region))
    if {"lat", "lng"} <= set(tier.columns):
        rows = rows.where(near_bounds(v, region.get("resolution", 4)))
    return rows.orderBy(F.desc("rarity"), "jd", "node").limit(v.limit)


def top_rows(df: DataFrame, where: Column, by: Column, *ties: str, limit: int) -> DataFrame:
    """The general form: filter, order, limit."""
    return df.where(where).orderBy(by, *ties).limit(limit)


def superset(*tiers: DataFrame) -> DataFrame:
    """Tiers of different columns as one frame, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiers)


def common_names(df: DataFrame) -> DataFrame:
    """One name for what tiers call differently: potential, shear, leaf."""
    has = set(df.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in has], F.lit(None))
    return df.withColumns({"potential": pick("potential", "max_potential"), "shear": pick("shear", "peak_shear"), "leaf": pick("leaf", "archetype")})


def with_century(df: DataFrame) -> DataFrame:
    return df.withColumn("century", century_of(F.col("jd")))


def at_point(df: DataFrame, lat: float, lng: float, jd: float, degrees: float = 1.0, hours: float = 1.0) -> DataFrame:
    """The rarest row within a band of place and time, not the nearest."""
    near = F.col("lat").between(lat - degrees, lat + degrees) & F.col("lng").between(lng - degrees, lng + degrees)
    return df.where(near & F.col("jd").between(jd - hours / 24, jd + hours / 24)).orderBy(F.desc("rarity"), "jd", "node").limit(1)


