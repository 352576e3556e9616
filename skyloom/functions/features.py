"""Feature vectors of an observer's sky, as array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.angles import angular_separation, clamp, norm, unit_vector, wrap_angle
from skyloom.functions.calendar import col

#: Harmonics of the interference descriptor.
HARMONICS = (1, 2, 3, 4, 6)


def state_vector(lon, lat, r, lon_rate, lat_rate, r_rate) -> Column:
    """Seven numbers of a body: direction, angular rates, distance and its rate."""
    return F.concat(unit_vector(lon, lat), F.array(col(lon_rate), col(lat_rate), col(r), col(r_rate)))


def sky_vector(lon, lat, lon_rate, scale: float = 15.0) -> Column:
    """Direction and squashed speed of a body."""
    return F.concat(unit_vector(lon, lat), F.array(F.tanh(col(lon_rate) / scale)))


def decode_direction(v: Column) -> Column:
    """struct(lon, lat) of an array that starts with a direction."""
    return F.struct(F.atan2(v[1], v[0]).alias("lon"), F.asin(clamp(v[2], -1.0, 1.0)).alias("lat"))


def elongation(lon, lat, sun_lon, sun_lat) -> Column:
    """The angle to the Sun."""
    lon, lat, sun_lon, sun_lat = map(col, (lon, lat, sun_lon, sun_lat))
    return F.acos(clamp(F.sin(lat) * F.sin(sun_lat) + F.cos(lat) * F.cos(sun_lat) * F.cos(lon - sun_lon), -1.0, 1.0))


def observer_row(lat, lon, lst) -> Column:
    """Sines and cosines of place and sidereal time, and two zeros."""
    return F.array(*[f(col(x)) for x in (lat, lon, lst) for f in (F.sin, F.cos)], F.lit(0.0), F.lit(0.0))


def pair_indices(n: int) -> list[tuple[int, int]]:
    """Unordered pairs in order: (0, 1), (0, 2), ..."""
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def fourier(values: Column, bands: int, raw: bool = True) -> Column:
    """Each number of an array (itself first, if ``raw``), then sine and cosine of pi times it, doubled band by band; without bands the array as it is."""
    if bands <= 0:
        return values
    turn = lambda x, k: (1 << k) * math.pi * x
    wide = lambda x: F.array(*([x] if raw else []), *[f(turn(x, k)) for k in range(bands) for f in (F.sin, F.cos)])
    return F.flatten(F.transform(values, lambda x: wide(x.cast("double"))))


def chroma_disk(x, y, most: float) -> Column:
    """struct(a, b): two numbers of any size drawn into a disk of radius ``most``, directions kept."""
    x, y = col(x), col(y)
    scale = most / F.sqrt(1 + x * x + y * y)
    return F.struct((x * scale).alias("a"), (y * scale).alias("b"))


def chroma_polar(x, hue, most: float) -> Column:
    """struct(a, b): a number squashed to a chroma below ``most``, at a hue."""
    chroma = most / (1 + F.exp(-col(x)))
    return F.struct((chroma * F.cos(col(hue))).alias("a"), (chroma * F.sin(col(hue))).alias("b"))


def horizon_gate(up, k: float = 8.0) -> Column:
    """How visible a body is by its zenith component."""
    return 1.0 / (1.0 + F.exp(-k * col(up)))


def chords(vectors: Column, n: int) -> Column:
    """Dot products of all pairs of an array of n directions (arrays of three)."""
    return F.array(*[sum((vectors[i][c] * vectors[j][c] for c in (1, 2)), vectors[i][0] * vectors[j][0]) for i, j in pair_indices(n)])


def gated_chords(vectors: Column, n: int, k: float = 8.0) -> Column:
    """Chords weighted by both bodies' gates; the third component is up."""
    gates = F.transform(vectors, lambda v: horizon_gate(v[2], k))
    plain = chords(vectors, n)
    return F.array(*[plain[p] * gates[i] * gates[j] for p, (i, j) in enumerate(pair_indices(n))])


def target(vectors: Column, n: int, k: float = 8.0) -> Column:
    """All components, then the gated chords."""
    return F.concat(F.flatten(vectors), gated_chords(vectors, n, k))


def interference(lons: Column, n: int) -> Column:
    """cos(k (lon_i - lon_j)) for every harmonic k and pair."""
    return F.array(*[F.cos(k * (lons[i] - lons[j])) for k in HARMONICS for i, j in pair_indices(n)])


def sky_distance(a: Column, b: Column, n_local: int, w_local: float = 1.0, w_rel: float = 1.0) -> Column:
    """Distance of two targets: root mean squares of the local and the relational difference, weighted."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    local, rest = F.slice(diff, 1, n_local), F.slice(diff, n_local + 1, F.size(diff) - n_local)
    return w_local * norm(local) / n_local**0.5 + w_rel * norm(rest) / F.sqrt(F.size(rest).cast("double"))


def isometric_error(color_a: Column, color_b: Column, sky: Column, gamma: float = 0.35) -> Column:
    """Squared difference of a colour distance from gamma times the sky distance."""
    gap = norm(F.zip_with(color_a, color_b, lambda x, y: x.cast("double") - y.cast("double")))
    return (gap - gamma * sky) * (gap - gamma * sky)


def geodesic_error(recon: Column, truth: Column) -> Column:
    """Angle between two horizon directions plus that between two ascendant offsets, of 5-vectors."""
    unit = lambda v: F.transform(F.array(F.greatest(norm(F.slice(v, 1, 3)), F.lit(1e-9))), lambda m: F.transform(F.slice(v, 1, 3), lambda x: x / m))[0]
    cosine = F.aggregate(F.zip_with(unit(recon), unit(truth), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    offset = lambda v: F.atan2(v[4], v[3])
    return F.acos(clamp(cosine, -1 + 1e-7, 1 - 1e-7)) + angular_separation(offset(recon), offset(truth))


def aspect_error(recon: Column, truth: Column, n: int) -> Column:
    """Mean difference of two configurations' separations: no rotation of either changes it."""
    sep = lambda v, i, j: F.abs(wrap_angle(v[i] - v[j]))
    terms = [F.abs(sep(recon, i, j) - sep(truth, i, j)) for i, j in pair_indices(n)]
    return 2 * sum(terms[1:], terms[0]) / (n * n)
