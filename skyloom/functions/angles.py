"""Angles, vectors, sidereal time and observer geometry, as column expressions (radians unless named _deg)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.calendar import J2000, col

TWO_PI = 2 * math.pi


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def wrap_angle(x) -> Column:
    """[-pi, pi)."""
    return F.pmod(col(x) + math.pi, F.lit(TWO_PI)) - math.pi


def wrap180(x) -> Column:
    return F.pmod(col(x) + 180.0, F.lit(360.0)) - 180.0


def angular_separation(a, b) -> Column:
    return F.abs(wrap_angle(col(a) - col(b)))


def separation_deg(a, b) -> Column:
    """Folded to [0, 180]."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def interpolate_angle(a, b, t) -> Column:
    """From a to b the short way round, in degrees."""
    return col(a) + wrap180(col(b) - col(a)) * col(t)


def unit_vector(lon, lat) -> Column:
    lon, lat = col(lon), col(lat)
    return F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def lat_lon(x, y, z) -> Column:
    """struct(lat, lon) of a vector; z points north."""
    norm = F.sqrt(col(x) * col(x) + col(y) * col(y) + col(z) * col(z)) + 1e-12
    return F.struct(F.asin(clamp(col(z) / norm, -1.0, 1.0)).alias("lat"), F.atan2(col(y), col(x)).alias("lon"))


def dot(a: Column, b: Column) -> Column:
    """Of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def geodesic_distance(a: Column, b: Column, eps: float = 1e-7) -> Column:
    """The angle of two unit vectors, away from the ends of acos."""
    return F.acos(clamp(dot(a, b), -1.0 + eps, 1.0 - eps))


def great_circle_deg(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    c = F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.degrees(F.acos(clamp(c, -1.0, 1.0)))


def haversine_deg(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle degrees between points in degrees; exact for close ones."""
    lat1, lon1, lat2, lon2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(clamp(h, 0.0, 1.0))))


def step_along(lat, lon, bearing, distance) -> Column:
    """struct(lat, lon) after going a distance (radians) along a bearing."""
    lat, lon, bearing, distance = map(col, (lat, lon, bearing, distance))
    to = F.asin(clamp(F.sin(lat) * F.cos(distance) + F.cos(lat) * F.sin(distance) * F.cos(bearing), -1.0, 1.0))
    turn = F.atan2(F.sin(bearing) * F.sin(distance) * F.cos(lat), F.cos(distance) - F.sin(lat) * F.sin(to))
    return F.struct(to.alias("lat"), wrap_angle(lon + turn).alias("lon"))


def centuries(jd) -> Column:
    return (col(jd) - J2000) / 36525.0


def obliquity(jd) -> Column:
    """Mean obliquity (IAU 1980)."""
    t = centuries(jd)
    return F.radians(23.439291 - 0.0130042 * t - 1.64e-7 * t * t + 5.04e-7 * t * t * t)


def gmst_deg(jd) -> Column:
    """Greenwich mean sidereal time (IAU 1982), in [0, 360)."""
    d, t = col(jd) - J2000, centuries(jd)
    return F.pmod(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0, F.lit(360.0))


def ecliptic_to_equatorial(lon, lat, eps) -> Column:
    """struct(ra, dec)."""
    lon, lat, eps = map(col, (lon, lat, eps))
    sin_dec = F.sin(lat) * F.cos(eps) + F.cos(lat) * F.sin(eps) * F.sin(lon)
    ra = F.atan2(F.sin(lon) * F.cos(eps) - F.tan(lat) * F.sin(eps), F.cos(lon))
    return F.struct(F.pmod(ra, F.lit(TWO_PI)).alias("ra"), F.asin(clamp(sin_dec, -1.0, 1.0)).alias("dec"))


def ascendant(ramc, eps, lat) -> Column:
    """Ecliptic longitude of the rising point, in [0, 2 pi)."""
    ramc, eps, lat = map(col, (ramc, eps, lat))
    return F.pmod(F.atan2(F.cos(ramc), -(F.sin(ramc) * F.cos(eps) + F.tan(lat) * F.sin(eps))), F.lit(TWO_PI))


def midheaven(ramc, eps) -> Column:
    return F.pmod(F.atan2(F.sin(col(ramc)), F.cos(col(ramc)) * F.cos(col(eps))), F.lit(TWO_PI))


def vertex(ramc, eps, lat) -> Column:
    """Where the prime vertical meets the ecliptic in the west: what rises half a turn on, at the complement of the latitude."""
    return ascendant(col(ramc) + math.pi, eps, math.pi / 2 - col(lat))


def polar_fade(lat_deg, start: float = 60.0, stop: float = 88.0) -> Column:
    """1 up to ``start`` degrees of latitude, 0 from ``stop`` on, half a cosine between."""
    t = clamp((F.abs(col(lat_deg)) - start) / (stop - start), 0.0, 1.0)
    return 0.5 * (1 + F.cos(math.pi * t))
