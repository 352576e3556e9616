"""The daily sidereal positions table that twin search reads: one wide row per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.calendar import jd_to_gregorian
from skyloom.functions.zodiac import BODIES, ayanamsha, circle, degree_in_sign, nakshatra_of, navamsa_of, sign_of
from skyloom.sources.ephemeris import longitudes
from skyloom.sources.frames import days


def sidereal(df: DataFrame, jd: str = "jd") -> DataFrame:
    """Adds <body>_lon of the nine bodies, in sidereal degrees."""
    keep = df.columns
    wide = longitudes(df, jd).withColumn("_shift", ayanamsha(F.col(jd)))
    return wide.select(*keep, *[circle(F.col(f"{b.capitalize()}_lon") - F.col("_shift")).alias(f"{b}_lon") for b in BODIES])


def positions(spark: SparkSession, first_jd: float, last_jd: float) -> DataFrame:
    """jd, year and, per body, sign, deg, nak, nav, lon."""
    wide = sidereal(days(spark, first_jd, last_jd))
    out = [F.col("jd"), jd_to_gregorian(F.col("jd"))["year"].alias("year")]
    for b in BODIES:
        lon = F.col(f"{b}_lon")
        out += [
            sign_of(lon).cast("byte").alias(f"{b}_sign"),
            degree_in_sign(lon).cast("float").alias(f"{b}_deg"),
            nakshatra_of(lon).cast("byte").alias(f"{b}_nak"),
            navamsa_of(lon).cast("byte").alias(f"{b}_nav"),
            lon.cast("float").alias(f"{b}_lon"),
        ]
    return wide.select(out)
