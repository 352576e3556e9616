"""Aspects, eclipses, bands and significance, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.angles import separation_deg
from skyloom.functions.calendar import FRAMES_PER_DAY, col

# Entities in order with their weights, aspect angles, orbs, bands.
ENTITIES = ("Sun", "Moon", "Mercury", "Venus", "Mars", "Jupiter", "Saturn", "Rahu", "Ketu", "Ayanamsha")
WEIGHTS = (1.0, 1.0, 0.5, 0.5, 0.7, 0.9, 0.9, 0.6, 0.6, 0.0)
CONSTRUCTIVE = {"conjunction": 0.0, "sextile": 60.0, "trine": 120.0}
DESTRUCTIVE = {"square": 90.0, "opposition": 180.0}
ORB_DEG, ECLIPSE_ORB_DEG = 6.0, 12.0
BAND_PERIOD = {"micro": 1.0, "fast": 29.5 * FRAMES_PER_DAY, "cyclic": 2.135 * 365.25 * FRAMES_PER_DAY, "macro": 29.4 * 365.25 * FRAMES_PER_DAY}
BAND_BODIES = {"fast": ("Moon", "Mercury", "Venus"), "cyclic": ("Mars", "Sun", "Rahu", "Ketu"), "macro": ("Jupiter", "Saturn")}
STATIONING = ("Mercury", "Venus", "Mars", "Jupiter", "Saturn")


def kernel(sep, angle, orb=ORB_DEG) -> Column:
    """How near a separation is to an exact aspect."""
    return F.exp(-0.5 * F.pow((col(sep) - col(angle)) / col(orb), F.lit(2.0)))


def constructive(sep, orb=ORB_DEG) -> Column:
    return sum((kernel(sep, a, orb) for a in CONSTRUCTIVE.values()), F.lit(0.0))


def destructive(sep, orb=ORB_DEG) -> Column:
    return sum((kernel(sep, a, orb) for a in DESTRUCTIVE.values()), F.lit(0.0))


def eclipse(sun_deg, moon_deg, node_deg, orb=ECLIPSE_ORB_DEG) -> Column:
    """struct(solar, lunar, is_eclipse): nearness of Sun, Moon and node to a line."""
    phase = separation_deg(sun_deg, moon_deg)
    node = separation_deg(moon_deg, node_deg)
    node = kernel(F.least(node, F.abs(node - 180.0)), 0.0, orb)
    solar, lunar = kernel(phase, 0.0, orb) * node, kernel(phase, 180.0, orb) * node
    return F.struct(solar.alias("solar"), lunar.alias("lunar"), (F.greatest(solar, lunar) > 0.5).alias("is_eclipse"))


def is_applying(lon_a, lon_b, speed_a, speed_b) -> Column:
    """Whether the folded separation moves to its nearest aspect, by the sign of the relative speed (so order matters)."""
    sep = separation_deg(lon_a, lon_b)
    targets = [*CONSTRUCTIVE.values(), *DESTRUCTIVE.values()]
    nearest = F.array_min(F.array(*[F.struct(F.abs(sep - t).alias("far"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(targets)]))["t"]
    return (sep - nearest) * (col(speed_a) - col(speed_b)) < 0


def is_closing(lon_a, lon_b, speed_a, speed_b) -> Column:
    """As ``is_applying``, with the sign that the fold gives the speed: right for either order of the bodies."""
    turned = F.when(F.pmod(col(lon_a) - col(lon_b), F.lit(360.0)) <= 180, 1.0).otherwise(-1.0)
    return is_applying(lon_a, lon_b, turned * col(speed_a), turned * col(speed_b))


def band_gain(band: str, stride, sharpness: float = 1.5, offset: float = 1.0) -> Column:
    """How much of a band survives a sampling stride: a logistic in the log of the period."""
    x = math.log10(BAND_PERIOD[band]) - F.log10(F.greatest(col(stride).cast("double"), F.lit(1.0))) + offset
    return 1.0 / (1.0 + F.exp(-sharpness * x))


def band_gains(stride) -> Column:
    return F.create_map(*[x for b in BAND_PERIOD for x in (F.lit(b), band_gain(b, stride))])


def temporal_stride(span_frames, points: int = 1000) -> Column:
    span = F.greatest(col(span_frames).cast("long"), F.lit(1))
    return F.when(span <= points, F.lit(1)).otherwise(F.ceil(span / points)).cast("long")


def significance_percentile(span_years) -> Column:
    """95 for a year or less, 99.99 for the whole timeline, linear in the log of the span."""
    t = F.ln(F.greatest(col(span_years).cast("double"), F.lit(1.0))) / math.log(10256.0)
    return 95.0 + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 4.99
