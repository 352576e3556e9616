"""Julian Days, frames and the proleptic Gregorian calendar with astronomical years, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first frame's Julian Day, seconds and frames.
EPOCH_JD = 588465.5
FRAME_DAYS = 24 / 86400
FRAMES_PER_HOUR, FRAMES_PER_DAY = 150, 3600
J2000 = 2451545.0


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def frame_to_jd(frame) -> Column:
    return F.lit(EPOCH_JD) + col(frame) * F.lit(FRAME_DAYS)


def jd_to_frame(jd) -> Column:
    """The nearest frame; halves go to the even one."""
    return F.rint((col(jd) - EPOCH_JD) / FRAME_DAYS).cast("long")


def day_index(jd) -> Column:
    return _floor(col(jd) - EPOCH_JD)


def gregorian_to_jd(year, month, day, hour=0, minute=0, second=0) -> Column:
    """Days are counted from March, so that the leap day ends the year; all divisions round down."""
    y, m, d = (col(x).cast("long") for x in (year, month, day))
    early = F.when(m <= 2, 1).otherwise(0)
    y, m = y + 4800 - early, m + 12 * early - 3
    days = d + _floor((153 * m + 2) / 5) + 365 * y + _floor(y / 4) - _floor(y / 100) + _floor(y / 400) - 32045
    clock = (col(hour) - 12) / 24 + col(minute) / 1440 + col(second) / 86400
    return days.cast("double") + clock


def jd_to_gregorian(jd) -> Column:
    """struct(year, month, day, hour, minute, second); second is a double."""
    jd = col(jd).cast("double")
    z = _floor(jd + 0.5)
    fraction = jd + 0.5 - z
    a = z + 32044
    b = _floor((4 * a + 3) / 146097)
    c = a - _floor(146097 * b / 4)
    d = _floor((4 * c + 3) / 1461)
    e = c - _floor(1461 * d / 4)
    m = _floor((5 * e + 2) / 153)
    seconds = fraction * 86400
    hour = _floor(seconds / 3600)
    minute = _floor((seconds - hour * 3600) / 60)
    return F.struct(
        (100 * b + d - 4800 + _floor(m / 10)).cast("int").alias("year"),
        (m + 3 - 12 * _floor(m / 10)).cast("int").alias("month"),
        (e - _floor((153 * m + 2) / 5) + 1).cast("int").alias("day"),
        hour.cast("int").alias("hour"),
        minute.cast("int").alias("minute"),
        (seconds - hour * 3600 - minute * 60).alias("second"),
    )


#: Signed years of any length, a date, and optional time and offset.
ISO = r"^\s*([+-]?\d+)-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?)?\s*(?:(Z)|([+-])(\d{2}):?(\d{2}))?\s*$"


#: What ``parse_datetime`` reads of ``ISO``, each part closed by a comma; what may be absent counts as 0.
_PARTS = "$1,$2,$3,0$4,0$5,0$6,$8,0$9,0$10,"


def parse_datetime(text) -> Column:
    """The Julian Day of an ISO text with any astronomical year; a date alone is its midnight UTC; null if malformed.

    The parts stand under no condition, as Spark shares only what every row needs: a malformed text has none, and so no day.
    A year beyond the range of a long counts as 0.
    """
    text = col(text)
    parts = F.split(F.when(text.rlike(ISO), F.regexp_replace(text, ISO, _PARTS)), ",")
    part = lambda i, kind="long": F.get(parts, F.lit(i)).try_cast(kind)
    sign = F.when(F.get(parts, F.lit(6)) == "-", -1.0).otherwise(1.0)
    offset = sign * (part(7) / 24 + part(8) / 1440)
    return gregorian_to_jd(F.coalesce(part(0), F.lit(0).cast("long")), part(1), part(2), part(3), part(4), part(5, "double")) - offset


def jd_or_datetime(text) -> Column:
    """A number is a Julian Day, anything else a date.

    No text is both, so the greatest is the one that is there; behind ``coalesce`` the parts of a date would not be shared.
    """
    return F.greatest(col(text).try_cast("double"), parse_datetime(text))


def local_to_jd(date, time, tz_hours) -> Column:
    """The Julian Day (UT) of a local date and clock time."""
    return parse_datetime(F.concat_ws("T", col(date), col(time))) - col(tz_hours) / 24


def century_of(jd) -> Column:
    return F.floor(jd_to_gregorian(jd)["year"] / 100).cast("int")


def date_text(jd) -> Column:
    """YYYY-MM-DD CE or BCE; year 0 is 1 BCE."""
    g = jd_to_gregorian(jd)
    year = F.when(g["year"] > 0, g["year"]).otherwise(1 - g["year"])
    return F.format_string("%04d-%02d-%02d %s", year, g["month"], g["day"], F.when(g["year"] > 0, "CE").otherwise("BCE"))


def time_text(jd) -> Column:
    g = jd_to_gregorian(jd)
    return F.format_string("%02d:%02d UTC", g["hour"], g["minute"])


def local_mean_time_text(jd, lon_deg) -> Column:
    """Clock time at a longitude: 15 degrees an hour."""
    g = jd_to_gregorian(jd)
    minutes = F.rint(F.pmod(g["hour"] * 60 + g["minute"] + col(lon_deg) * 4, F.lit(1440.0))).cast("int") % 1440
    return F.format_string("%02d:%02d LMT", F.floor(minutes / 60).cast("int"), minutes % 60)
