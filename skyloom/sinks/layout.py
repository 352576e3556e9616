"""The order of rows in a tier's files, and a manifest of what each brick of them holds.

Rows go by rarity band, then by a space-filling key of time and place. The highest band is about the last ``PAGE`` rows by
rarity, each further one twice as many, so bands grow in number with the logarithm of the rows. Within a band the key interleaves
two bits of time with one of place, so neighbouring rows are near in both. A page of a file holds ``PAGE`` rows. A brick
is what shares so much of the key that it holds about ``BRICK`` rows of its band; the manifest keeps its bounds.

A viewport asks for the rarest rows of a time and place. Bricks that lie wholly inside it are known to give that many
rows of a known least rarity; once they give as many as are asked for, nothing below that rarity can be among the answers.
That bound, with those of time and place, is what the scan gets, and pages outside it are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from skyloom.operators.viewport import Viewport

PAGE, BRICK = 128, 32
#: Bands above the lowest, at most.
BANDS = 40
#: Steps of the key: two bits of time and one of place each, latitude and longitude in turn.
STEPS = 10
NEEDED = {"jd", "lat", "lng", "rarity"}
_BRICK = "brick"


def measured(rows: DataFrame, partition: str) -> Row:
    """What the order needs to know of ``rows``, in one pass: a, b (first and last jd), n, parts (values of ``partition``, which are few), q (rarities at the shares of all ``BANDS``)."""
    shares = [1 - 0.5**i for i in range(1, BANDS + 1)]
    quantiles = F.percentile_approx(F.col("rarity").cast("double"), shares, 10_000)
    return rows.agg(F.min("jd").alias("a"), F.max("jd").alias("b"), F.count("*").alias("n"), F.collect_set(partition).alias("parts"), quantiles.alias("q")).first()


def band_bounds(seen: Row) -> list[float]:
    """Least rarities of the bands but the lowest, in rising order: the quantiles 1/2, 3/4, 7/8 and so on, while a band has more than ``PAGE`` rows."""
    used = sum(seen["n"] * 0.5**i > PAGE for i in range(1, BANDS + 1))
    return sorted(set((seen["q"] or [])[:used]))


def _bit(value: Column, at: int) -> Column:
    return F.shiftright(value, at).bitwiseAND(1)


def keyed(rows: DataFrame, first: float, last: float) -> DataFrame:
    """Adds ``_key``: time between ``first`` and ``last`` and place, interleaved. The three numbers are columns first, so that the generated code stays short."""
    steps = 1 << (2 * STEPS)
    time = F.least(F.floor((F.col("jd") - first) / max(last - first, 1e-9) * steps), F.lit(steps - 1)).cast("long")
    half = 1 << (STEPS // 2)
    lat = F.least(F.floor((F.col("lat") + 90) / 180 * half), F.lit(half - 1)).cast("long")
    lng = F.pmod(F.floor((F.col("lng") + 180) / 360 * half), F.lit(half)).cast("long")
    out = F.lit(0).cast("long")
    for i in range(STEPS):
        place = F.shiftleft(_bit(F.col("_lat" if i % 2 else "_lng"), i // 2), 3 * i)
        out = out.bitwiseOR(F.shiftleft(F.shiftright("_time", 2 * i).bitwiseAND(3), 3 * i + 1)).bitwiseOR(place)
    return rows.withColumns({"_time": time, "_lat": lat, "_lng": lng}).withColumn("_key", out).drop("_time", "_lat", "_lng")


def arranged(rows: DataFrame, partition: str, seen: Row) -> DataFrame:
    """``rows``, of which ``measured`` tells ``seen``, dealt by range of band and key, in order, each with the number of its brick."""
    bounds = band_bounds(seen)
    band = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col("rarity") >= b)) if bounds else F.lit(0)
    order = [partition, "_band", "_key", "jd"]
    dealt = keyed(rows, seen["a"] or 0.0, seen["b"] or 0.0).withColumn("_band", -band)
    dealt = dealt.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    # Band i from below has half of what is left; the last one has all of it.
    sizes = [seen["n"] / 2 ** min(i + 1, len(bounds) or 1) for i in range(len(bounds) + 1)]
    cut = F.array(*[F.lit(3 * STEPS - min(int(size // BRICK).bit_length(), 3 * STEPS)) for size in sizes])
    brick = F.call_function("shiftleft", -F.col("_band").cast("long"), F.lit(3 * STEPS)) + F.call_function("shiftright", F.col("_key"), cut[-F.col("_band")])
    return dealt.withColumn(_BRICK, brick).drop("_band", "_key")


def bricks(written: DataFrame, by: list[str]) -> DataFrame:
    """One row per brick: its bounds in time, place and rarity, and its rows; bricks with a null among these bound nothing and are left out."""
    bounds = [f(c).alias(f"{c}_{f.__name__}") for c in ("jd", "lat", "lng", "rarity") for f in (F.min, F.max)]
    whole = F.sum(sum((F.col(c).isNull().cast("int") for c in sorted(NEEDED)), F.lit(0))) == 0
    return written.groupBy(*by, _BRICK).agg(F.count("*").alias("n"), *bounds, whole.alias("whole")).where("whole").drop("whole")


def least_rarity(manifest: DataFrame, v: Viewport, centuries: tuple[int, int]) -> float:
    """A rarity that at least ``v.limit`` rows of the viewport reach; its own bound if bricks inside it do not tell more."""
    inside = F.col("century").between(*centuries) & (F.col("jd_min") >= v.start) & (F.col("jd_max") <= v.end) & (F.col("lat_min") >= v.min_lat) & (F.col("lat_max") <= v.max_lat)
    if v.min_lng > v.max_lng:
        inside &= (F.col("lng_min") >= v.min_lng) | (F.col("lng_max") <= v.max_lng)
    else:
        inside &= (F.col("lng_min") >= v.min_lng) & (F.col("lng_max") <= v.max_lng)
    # A brick has a row at least, so as many bricks as rows are asked for tell enough.
    best = manifest.where(inside & (F.col("rarity_min") >= v.rarity_min)).orderBy(F.desc("rarity_min")).select(F.col("rarity_min").cast("double"), "n").limit(v.limit).collect()
    rows = 0
    for r in best:
        rows += r["n"]
        if rows >= v.limit:
            return max(v.rarity_min, r["rarity_min"])
    return v.rarity_min
