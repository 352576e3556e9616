"""Divisions of the sidereal circle; longitudes in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.calendar import col
from skyloom.functions.angles import centuries

# The bodies of a chart in order, and those that move slowly.
BODIES = ("sun", "moon", "mars", "mercury", "jupiter", "venus", "saturn", "rahu", "ketu")
SLOW = ("saturn", "jupiter", "rahu", "ketu")


def circle(x) -> Column:
    return F.pmod(col(x), F.lit(360.0))


def sign_of(lon) -> Column:
    return F.floor(circle(lon) / 30).cast("int")


def degree_in_sign(lon) -> Column:
    return F.pmod(col(lon), F.lit(30.0))


def nakshatra_of(lon) -> Column:
    return F.floor(circle(lon) / (360.0 / 27)).cast("int")


def navamsa_of(lon) -> Column:
    return F.pmod(sign_of(lon) * 9 + F.floor(degree_in_sign(lon) / (30.0 / 9)), F.lit(12)).cast("int")


def house_of(sign, ascendant_sign) -> Column:
    """Whole-sign house, 1 to 12."""
    return (F.pmod(col(sign) - col(ascendant_sign), F.lit(12)) + 1).cast("int")


def ayanamsha(jd) -> Column:
    """Precession since the sidereal zodiac's origin: the Lahiri value at J2000 and general precession (IAU 1976)."""
    t = centuries(jd)
    return 23.85709235 + (5029.0966 * t + 1.11113 * t * t - 0.000006 * t * t * t) / 3600.0
