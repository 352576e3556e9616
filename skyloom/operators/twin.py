"""Twin search: days whose positions repeat a natal chart, in eight tiers of strictness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.angles import ascendant, gmst_deg, obliquity, separation_deg, wrap180
from skyloom.functions.calendar import date_text, local_mean_time_text, time_text
from skyloom.functions.zodiac import BODIES, SLOW, ayanamsha, circle, degree_in_sign, house_of, nakshatra_of, navamsa_of, sign_of
from skyloom.sources.positions import sidereal

ORB_DEG = 5.0
TIERS = range(1, 9)
#: Tiers whose houses can be met anywhere only at certain longitudes.
HOUSE_TIERS = (3, 4, 8)
#: Latitudes of the locus, and results that carry it.
LOCUS_LATS = (-55.0, -40.0, -25.0, -10.0, 0.0, 10.0, 25.0, 40.0, 55.0)
LOCUS_ROWS = 200
MAX_LIMIT = 1000


def ascendant_sidereal(jd: Column, lat_deg: Column, lon_deg: Column) -> Column:
    ramc = F.radians(F.pmod(gmst_deg(jd) + lon_deg, F.lit(360.0)))
    return circle(F.degrees(ascendant(ramc, obliquity(jd), F.radians(lat_deg))) - ayanamsha(jd))


def natal_key(spark: SparkSession, jd: float, lat_deg: float, lon_deg: float) -> dict:
    """Bodies (lon, sign, deg, nak, nav, house), ascendant sign, and groups that share a sign in order of degree."""
    row = sidereal(spark.createDataFrame([(jd,)], "jd double"))
    asc = sign_of(ascendant_sidereal(F.col("jd"), F.lit(lat_deg), F.lit(lon_deg)))
    body = lambda lon: F.struct(
        F.round(lon, 5).alias("lon"), sign_of(lon).alias("sign"), F.round(degree_in_sign(lon), 5).alias("deg"),
        nakshatra_of(lon).alias("nak"), navamsa_of(lon).alias("nav"), house_of(sign_of(lon), asc).alias("house"),
    )
    got = row.select(asc.alias("asc"), *[body(F.col(f"{b}_lon")).alias(b) for b in BODIES]).first()
    return key_of({b: got[b].asDict() for b in BODIES}, got["asc"])


def key_of(bodies: dict[str, dict], ascendant_sign: int) -> dict:
    """A natal key from its bodies."""
    groups: dict[int, list[str]] = {}
    for b in bodies:
        groups.setdefault(bodies[b]["sign"], []).append(b)
    together = [sorted(g, key=lambda b: bodies[b]["deg"]) for g in groups.values() if len(g) > 1]
    return {"ascendant_sign": ascendant_sign, "bodies": bodies, "conjunctions": together}


def active_bodies(natal: dict, bodies: list[str] | None = None, houses: list[int] | None = None) -> list[str]:
    """The bodies whose conditions hold: residents of chosen houses, or a chosen list, or all; in canonical order."""
    if houses:
        return [b for b in BODIES if b in natal["bodies"] and natal["bodies"][b]["house"] in set(houses)]
    return [b for b in BODIES if b in natal["bodies"] and (bodies is None or b in set(bodies))]


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def tier_condition(natal: dict, tier: int, active: list[str], orb: float = ORB_DEG) -> Column:
    """What a day must meet. No active bodies means no condition."""
    own = natal["bodies"]
    signs = lambda names: [F.col(f"{b}_sign") == own[b]["sign"] for b in names]
    orbs = [separation_deg(F.col(f"{b}_lon").cast("double"), F.lit(float(own[b]["lon"]))) <= orb for b in active]
    moon = [F.col("moon_nak") == own["moon"]["nak"]] if "moon" in active else []
    if tier == 1:
        return every(signs([b for b in active if b in SLOW]))
    if tier in (2, 4):
        return every(signs(active))
    if tier == 3:
        turned = [F.pmod(F.col(f"{b}_sign") - own[b]["sign"], F.lit(12)) for b in active]
        return every([t == turned[0] for t in turned[1:]])
    if tier == 5:
        return every(signs(active) + moon)
    if tier == 6:
        ordered = [[b for b in g if b in active] for g in natal["conjunctions"]]
        wars = [F.col(f"{a}_deg") < F.col(f"{b}_deg") for g in ordered for a, b in zip(g, g[1:], strict=False)]
        return every(signs(active) + moon + wars)
    if tier == 7:
        return every(orbs)
    if tier == 8:
        return every([F.col(f"{b}_nav") == own[b]["nav"] for b in active] + orbs)
    raise ValueError("the tier must be 1 to 8")


def total_matched(natal: dict, tier: int, orb: float = ORB_DEG) -> Column:
    """How many of all bodies meet the tier's criterion; for tier 3, how many share the commonest turn."""
    own = natal["bodies"]
    if tier in (7, 8):
        hits = [separation_deg(F.col(f"{b}_lon").cast("double"), F.lit(float(own[b]["lon"]))) <= orb for b in own]
    elif tier == 3:
        turned = F.array(*[F.pmod(F.col(f"{b}_sign") - own[b]["sign"], F.lit(12)).cast("int") for b in own])
        return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.size(F.filter(turned, lambda t: t == k))))
    else:
        hits = [F.col(f"{b}_sign") == own[b]["sign"] for b in own]
    return sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))


def between_years(first: int | None, last: int | None) -> Column:
    bounds = ([F.col("year") >= first] if first is not None else []) + ([F.col("year") <= last] if last is not None else [])
    return every(bounds)


def search(
    positions: DataFrame, natal: dict, tier: int, limit: int = 300, bodies: list[str] | None = None, houses: list[int] | None = None,
    first_year: int | None = None, last_year: int | None = None,
) -> DataFrame:
    """The first matching days: jd, total_matched, match_score, location_free. An empty active set matches nothing."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"the limit must be 1 to {MAX_LIMIT}")
    active = active_bodies(natal, bodies, houses)
    condition = tier_condition(natal, tier, active) if active else F.lit(False)
    found = positions.where(condition & between_years(first_year, last_year)).orderBy("jd").limit(limit)
    return found.select(
        "jd", date_text(F.col("jd")).alias("date"), total_matched(natal, tier).alias("total_matched"),
        F.lit(round(len(active) / len(BODIES), 3)).alias("match_score"), F.lit(tier not in HOUSE_TIERS).alias("location_free"),
    )


def available(positions: DataFrame, natal: dict, bodies: list[str] | None = None, houses: list[int] | None = None) -> DataFrame:
    """One row of eight flags: whether any day meets each tier, in one scan."""
    active = active_bodies(natal, bodies, houses)
    flag = lambda t: F.coalesce(F.bool_or(tier_condition(natal, t, active) if active else F.lit(False)), F.lit(False))
    return positions.agg(*[flag(t).alias(f"tier_{t}") for t in TIERS])


def longitude_bands(days: DataFrame, target_sign: int, lats: tuple[float, ...] = (0.0,), step: float = 0.5) -> DataFrame:
    """(jd, lat, width, lon): bands of longitude where the ascendant is in a sign, widest first within jd and lat.

    A band is a run of hits on the grid from -180 on; one that crosses the seam is two.
    """
    grid = days.select("jd").withColumn("lat", F.explode(F.array(*[F.lit(x) for x in lats]))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(round(360 / step) - 1))))
    lon = F.col("i") * step - 180.0
    hits = grid.withColumn("lon", lon).where(sign_of(ascendant_sidereal(F.col("jd"), F.col("lat"), F.col("lon"))) == target_sign)
    run = F.col("i") - F.row_number().over(Window.partitionBy("jd", "lat").orderBy("i"))
    bands = hits.withColumn("_r", run).groupBy("jd", "lat", "_r").agg(F.count("*").alias("width"), F.avg("lon").alias("lon"))
    order = Window.partitionBy("jd", "lat").orderBy(F.desc("width"), "lon")
    return bands.select("jd", "lat", "width", F.round(wrap180(F.col("lon")), 4).alias("lon")).withColumn("rank", F.row_number().over(order))


def refined(bands: DataFrame, target_sign: int, span: float = 1.0) -> DataFrame:
    """The middle hit within a degree of each widest band's centre, by arc minutes; the centre itself if none hits."""
    tries = bands.where("rank = 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(round(2 * span * 60) - 1))))
    tries = tries.withColumn("at", F.col("lon") - span + F.col("k") / 60.0)
    hit = sign_of(ascendant_sidereal(F.col("jd"), F.col("lat"), F.col("at"))) == target_sign
    hits = tries.groupBy("jd", "lat", "lon").agg(F.sort_array(F.collect_list(F.when(hit, F.col("at")))).alias("h"))
    return hits.select("jd", "lat", F.round(F.coalesce(F.get("h", F.floor(F.size("h") / 2).cast("int")), "lon"), 5).alias("lon"))


def with_places(found: DataFrame, natal: dict, tier: int, lat_deg: float) -> DataFrame:
    """House tiers: each day's longitude and local time, and the locus of the first ones; days without a longitude go."""
    if tier not in HOUSE_TIERS:
        return found.withColumn("time", time_text(F.col("jd")))
    sign = natal["ascendant_sign"]
    bands = longitude_bands(found, sign, (lat_deg,))
    place = refined(bands, sign) if tier == 8 else bands.where("rank = 1")
    first = found.orderBy("jd").limit(LOCUS_ROWS)
    locus = longitude_bands(first, sign, LOCUS_LATS).where("rank = 1")
    points = locus.groupBy("jd").agg(F.sort_array(F.collect_list(F.struct("lat", F.round("lon", 3).alias("lon")))).alias("globe_points"))
    joined = found.join(place.select("jd", "lon"), "jd").join(points, "jd", "left")
    return joined.withColumns({"time": time_text(F.col("jd")), "local_time": local_mean_time_text(F.col("jd"), F.col("lon"))})
