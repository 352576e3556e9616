"""Closed-form sky positions as column expressions.

Planets follow Keplerian elements with linear rates, the Moon a short series, the
node its mean motion. All of it is arithmetic on columns, so a million instants are
one codegen stage; every step is a projection of its own, which keeps the optimiser
from repeating it inside the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.angles import centuries, wrap180
from skyloom.functions.calendar import J2000
from skyloom.functions.zodiac import ayanamsha

# Keplerian elements at J2000 (au, -, deg, deg, deg, deg) and their rates a century.
ELEMENTS = {
    "Mercury": ((0.38709927, 0.20563593, 7.00497902, 252.25032350, 77.45779628, 48.33076593), (0.00000037, 0.00001906, -0.00594749, 149472.67411175, 0.16047689, -0.12534081)),
    "Venus": ((0.72333566, 0.00677672, 3.39467605, 181.97909950, 131.60246718, 76.67984255), (0.00000390, -0.00004107, -0.00078890, 58517.81538729, 0.00268329, -0.27769418)),
    "Earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "Mars": ((1.52371034, 0.09339410, 1.84969142, -4.55343205, -23.94362959, 49.55953891), (0.00001847, 0.00007882, -0.00813131, 19140.30268499, 0.44441088, -0.29257343)),
    "Jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "Saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "Uranus": ((19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-0.00196176, -0.00004397, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "Neptune": ((30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (0.00026291, 0.00005105, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
    "Pluto": ((39.48211675, 0.24882730, 17.14001206, 238.92903833, 224.06891629, 110.30393684), (-0.00031596, 0.00005170, 0.00004818, 145.20780515, -0.04062942, -0.01183482)),
}
# Lunar mean arguments (deg, deg a day), and terms in degrees by multiples of D, M, M', F.
MOON_ARGUMENTS = {"L": (218.3164477, 13.17639648), "D": (297.8501921, 12.19074920), "M": (357.5291092, 0.98560028), "P": (134.9633964, 13.06499295), "F": (93.2720950, 13.22935024)}
MOON_LONGITUDE = ((6.289, 0, 0, 1, 0), (1.274, 2, 0, -1, 0), (0.658, 2, 0, 0, 0), (0.214, 0, 0, 2, 0), (-0.186, 0, 1, 0, 0), (-0.114, 0, 0, 0, 2), (0.059, 2, 0, -2, 0), (0.057, 2, -1, -1, 0))
MOON_LATITUDE = ((5.128, 0, 0, 0, 1), (0.280, 0, 0, 1, 1), (0.277, 0, 0, 1, -1), (0.173, 2, 0, 0, -1), (0.055, 2, 0, -1, 1), (0.046, 2, 0, -1, -1))
NODE = (125.04452, -0.05295377)
#: Mean lunar distance, in au; the series has no distance of its own.
MOON_AU = 384400.0 / 149597870.7

PLANETS = tuple(p for p in ELEMENTS if p != "Earth")
#: Bodies of a frame; Ketu opposes Rahu, Ayanamsha is the precession angle.
BODIES = ("Sun", "Moon", "Mercury", "Venus", "Mars", "Jupiter", "Saturn", "Rahu", "Ketu", "Ayanamsha")
NEWTON_STEPS = 6


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def _heliocentric(df: DataFrame, planet: str, t: Column) -> DataFrame:
    """Adds the planet's ecliptic x, y, z as <planet>_x, ..."""
    base, rate = ELEMENTS[planet]
    a, e, inc, mean, peri, node = (b + r * t for b, r in zip(base, rate, strict=True))
    names = [f"_{planet}_{x}" for x in ("a", "e", "i", "w", "n", "m")]
    df = df.withColumns(dict(zip(names, (a, e, F.radians(inc), F.radians(peri - node), F.radians(node), F.radians(wrap180(mean - peri))), strict=True)))
    a, e, i, w, n, m = (F.col(x) for x in names)
    anomaly = f"_{planet}_anomaly"
    df = df.withColumn(anomaly, m + e * F.sin(m))
    for _ in range(NEWTON_STEPS):
        x = F.col(anomaly)
        df = df.withColumn(anomaly, x - (x - e * F.sin(x) - m) / (1 - e * F.cos(x)))
    x, y = f"_{planet}_p", f"_{planet}_q"
    df = _add(df, **{x: a * (F.cos(anomaly) - e), y: a * F.sqrt(1 - e * e) * F.sin(anomaly)})
    p, q = F.col(x), F.col(y)
    out = {
        f"{planet}_x": (F.cos(w) * F.cos(n) - F.sin(w) * F.sin(n) * F.cos(i)) * p - (F.sin(w) * F.cos(n) + F.cos(w) * F.sin(n) * F.cos(i)) * q,
        f"{planet}_y": (F.cos(w) * F.sin(n) + F.sin(w) * F.cos(n) * F.cos(i)) * p - (F.sin(w) * F.sin(n) - F.cos(w) * F.cos(n) * F.cos(i)) * q,
        f"{planet}_z": F.sin(w) * F.sin(i) * p + F.cos(w) * F.sin(i) * q,
    }
    return df.withColumns(out).drop(*names, anomaly, x, y)


def moon(jd: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    d = jd - J2000
    arg = {k: F.radians(a + b * d) for k, (a, b) in MOON_ARGUMENTS.items()}
    series = lambda terms: sum((c * F.sin(p * arg["D"] + q * arg["M"] + r * arg["P"] + s * arg["F"]) for c, p, q, r, s in terms), F.lit(0.0))
    first, rate = MOON_ARGUMENTS["L"]
    return first + rate * d + series(MOON_LONGITUDE), series(MOON_LATITUDE)


def node(jd: Column) -> Column:
    return NODE[0] + NODE[1] * (jd - J2000)


def longitudes(df: DataFrame, jd: str = "jd", planets: tuple[str, ...] = ("Mercury", "Venus", "Mars", "Jupiter", "Saturn")) -> DataFrame:
    """Adds tropical <body>_lon, <body>_lat (degrees) and <body>_r (au) of Sun, Moon, planets, nodes and Ayanamsha."""
    keep = df.columns
    t = centuries(F.col(jd))
    df = _heliocentric(df, "Earth", t)
    geocentric = {"Sun": [-F.col(f"Earth_{c}") for c in "xyz"]}
    for p in planets:
        df = _heliocentric(df, p, t)
        geocentric[p] = [F.col(f"{p}_{c}") - F.col(f"Earth_{c}") for c in "xyz"]
    df = df.withColumns({f"_{b}_{c}": v for b, xyz in geocentric.items() for c, v in zip("xyz", xyz, strict=True)})
    out = {}
    for b in geocentric:
        x, y, z = (F.col(f"_{b}_{c}") for c in "xyz")
        out[f"{b}_lon"] = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
        out[f"{b}_lat"] = F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
        out[f"{b}_r"] = F.sqrt(x * x + y * y + z * z)
    lon, lat = moon(F.col(jd))
    rahu = F.pmod(node(F.col(jd)), F.lit(360.0))
    out |= {"Moon_lon": F.pmod(lon, F.lit(360.0)), "Moon_lat": lat, "Moon_r": F.lit(MOON_AU)}
    out |= {"Rahu_lon": rahu, "Ketu_lon": F.pmod(rahu + 180, F.lit(360.0)), "Ayanamsha_lon": F.pmod(ayanamsha(F.col(jd)), F.lit(360.0))}
    for b in ("Rahu", "Ketu", "Ayanamsha"):
        out |= {f"{b}_lat": F.lit(0.0), f"{b}_r": F.lit(MOON_AU if b != "Ayanamsha" else 1.0)}
    df = df.withColumns(out)
    return df.select(*keep, *out)


def global_state(df: DataFrame, jd: str = "jd", step: float = 1 / 1440) -> DataFrame:
    """Long rows (..., body_id, body, lon, lat, x, y, z, lon_rate, lat_rate, r, r_rate); angles in radians, rates a day by central difference."""
    key = df.columns
    instants = df.withColumn("_at", F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)))).withColumn("_jd", F.col(jd) + F.col("_at") * step)
    wide = longitudes(instants, "_jd")
    bodies = F.array(*[F.struct(F.lit(i).alias("body_id"), F.lit(b).alias("body"), F.radians(f"{b}_lon").alias("lon"), F.radians(f"{b}_lat").alias("lat"), F.col(f"{b}_r").alias("r")) for i, b in enumerate(BODIES)])
    rows = wide.select(*key, "_at", F.explode(bodies).alias("b")).select(*key, "_at", "b.*")
    at = lambda name, k: F.max(F.when(F.col("_at") == k, F.col(name)))
    wrapped = F.pmod(F.col("_lon2") - F.col("_lon0") + math.pi, F.lit(2 * math.pi)) - math.pi
    joined = rows.groupBy(*key, "body_id", "body").agg(*[at(n, k - 1.0).alias(f"_{n}{k}") for n in ("lon", "lat", "r") for k in (0, 1, 2)])
    lon, lat = F.col("_lon1"), F.col("_lat1")
    return joined.select(
        *key, "body_id", "body", lon.alias("lon"), lat.alias("lat"),
        (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"),
        (wrapped / (2 * step)).alias("lon_rate"), ((F.col("_lat2") - F.col("_lat0")) / (2 * step)).alias("lat_rate"),
        F.col("_r1").alias("r"), ((F.col("_r2") - F.col("_r0")) / (2 * step)).alias("r_rate"),
    )
