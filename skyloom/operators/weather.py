"""Aspects, concentration and local intensity of instants, and projection onto observers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import aspects as A
from skyloom.functions.angles import ascendant, clamp, gmst_deg, obliquity, separation_deg, wrap_angle

EARTH_AU = 6378.137 / 149597870.7
#: Entities with parallax: the physical bodies.
N_PHYSICAL = 7


def weights() -> Column:
    return F.array(*[F.lit(w) for w in A.WEIGHTS])


def skies(rows: DataFrame, key: str = "jd") -> DataFrame:
    """(key, lons): the longitudes of each instant's bodies in their order, from rows (key, body_id, lon) in radians; rows that have ``lons`` are taken as they are."""
    if "lons" in rows.columns:
        return rows.select(key, "lons")
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("body_id", "lon"))), lambda x: x["lon"]).alias("lons"))


_FIRST, _SECOND = np.triu_indices(len(A.ENTITIES), 1)
_JOINT = np.array(A.WEIGHTS)[_FIRST] * np.array(A.WEIGHTS)[_SECOND]
_ANGLES = np.array([*A.CONSTRUCTIVE.values(), *A.DESTRUCTIVE.values()])


class _Sky:
    """A batch of skies: longitudes by instant and body, and the separation of each pair; ``lacks`` tells which are null."""

    def __init__(self, lons: pa.ListArray):
        size = pc.fill_null(pc.list_value_length(lons), 0).to_numpy().astype(np.int64)
        flat = lons.flatten()
        row, body = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.lon, self.lacks = np.full((len(size), len(A.ENTITIES)), np.nan), np.ones((len(size), len(A.ENTITIES)), bool)
        self.lon[row, body], self.lacks[row, body] = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
        self.deg = np.degrees(self.lon)
        self.sep, self.pair_lacks = self.fold(_FIRST, _SECOND), self.lacks[:, _FIRST] | self.lacks[:, _SECOND]

    def fold(self, i, j) -> np.ndarray:
        apart = np.abs(self.deg[:, i] - self.deg[:, j])
        return np.minimum(apart, 360 - apart)

    def kernels(self, angles: np.ndarray) -> np.ndarray:
        """The joint weight times the nearness of each pair to some aspects in all, 0 where a pair lacks."""
        near = sum(np.exp(-0.5 * ((self.sep - x) / A.ORB_DEG) ** 2) for x in angles)
        return np.where(self.pair_lacks, 0.0, near * _JOINT)

    def field(self) -> list[pa.Array]:
        """Resonance and tension."""
        none = self.pair_lacks.all(1)
        n = len(A.CONSTRUCTIVE)
        return [pa.array(self.kernels(x).sum(1), mask=none) for x in (_ANGLES[:n], _ANGLES[n:])]

    def active(self) -> tuple[np.ndarray, np.ndarray]:
        """The activation of each body, and where there is none."""
        e, out, none = self.kernels(_ANGLES), np.zeros(self.lon.shape), np.ones(self.lon.shape, bool)
        for k, ends in enumerate(zip(_FIRST, _SECOND, strict=True)):
            for body in ends:
                out[:, body] += e[:, k]
                none[:, body] &= self.pair_lacks[:, k]
        return out, none

    def strongest(self, top: int, least: float) -> tuple[np.ndarray, ...]:
        """(instant, pair, aspect, strength, rank) of the strongest aspects; NaN is the greatest strength, as in an ORDER BY."""
        near = np.exp(-0.5 * ((self.sep[:, :, None] - _ANGLES) / A.ORB_DEG) ** 2)
        use = (~self.pair_lacks & (_JOINT > 0))[:, :, None] & ~(near <= least)
        row, pair, aspect = np.nonzero(use)
        strength = near[row, pair, aspect] * _JOINT[pair]
        order = np.lexsort((aspect, pair, np.where(np.isnan(strength), -np.inf, -np.round(strength, 9)), row))
        row, pair, aspect, strength = row[order], pair[order], aspect[order], strength[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        keep = rank <= top
        return row[keep], pair[keep], aspect[keep], strength[keep], rank[keep]


def _in_place(sky: DataFrame, key: str, columns: str, made) -> DataFrame:
    """(key, columns) of skies (key, lons), batch by batch: ``made`` gives the rows of the batch that results are of (None: each once) and the results."""
    kept = sky.select(key, "lons")
    schema = f"`{key}` {kept.schema[key].dataType.simpleString()}, {columns}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            row, out = made(_Sky(batch.column("lons")))
            name = batch.column(key)
            name = name if row is None else name.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([name, *out], names=[key, *[c.split()[0] for c in columns.split(", ")]])

    return kept.mapInArrow(run, schema)


def pairs(rows: DataFrame, key: str = "jd") -> DataFrame:
    """Unordered body pairs of each instant: a < b, separation, joint weight. rows: (key, body_id, lon) in radians, or ``skies``.

    The ten bodies of an instant are one array, so pairs come without a join.
    """
    ids = [(i, j) for i in range(len(A.ENTITIES)) for j in range(i + 1, len(A.ENTITIES))]
    made = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), separation_deg(F.degrees(F.col("lons")[i]), F.degrees(F.col("lons")[j])).alias("sep"), F.lit(A.WEIGHTS[i] * A.WEIGHTS[j]).alias("w")) for i, j in ids])
    return skies(rows, key).select(key, F.explode(made).alias("p")).select(key, "p.*")


def aspect_field(pair: DataFrame, key: str = "jd") -> DataFrame:
    """(key, resonance, tension, net) of each instant, from pairs, or from skies (key, lons) in place."""
    if "lons" in pair.columns:
        sums = _in_place(pair, key, "resonance double, tension double", lambda sky: (None, sky.field()))
    else:
        w = F.col("w")
        sums = pair.groupBy(key).agg(F.sum(w * A.constructive(F.col("sep"))).alias("resonance"), F.sum(w * A.destructive(F.col("sep"))).alias("tension"))
    return sums.withColumn("net", F.col("resonance") - F.col("tension"))


def activation(pair: DataFrame, key: str = "jd") -> DataFrame:
    """(key, body_id, activation): each body's part in all aspects, from pairs, or from skies (key, lons) in place."""
    if "lons" in pair.columns:

        def each(sky: _Sky):
            out, none = sky.active()
            n, k = out.shape
            return np.repeat(np.arange(n), k), [pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(out.ravel(), mask=none.ravel())]

        return _in_place(pair, key, "body_id int, activation double", each)
    e = F.col("w") * (A.constructive(F.col("sep")) + A.destructive(F.col("sep")))
    both = pair.withColumn("_e", e).select(key, F.explode(F.array("a", "b")).alias("body_id"), "_e")
    return both.groupBy(key, "body_id").agg(F.sum("_e").alias("activation"))


def band_energies(active: DataFrame, key: str = "jd") -> DataFrame:
    """(key, band, energy): activation summed by the band a body drives, from activations, or from skies (key, lons) in place."""
    if "lons" in active.columns:

        def each(sky: _Sky):
            out, none = sky.active()
            groups = [[A.ENTITIES.index(b) for b in bodies] for bodies in A.BAND_BODIES.values()]
            energy, lacks = np.stack([out[:, g].sum(1) for g in groups], axis=1), np.stack([none[:, g].all(1) for g in groups], axis=1)
            n, k = energy.shape
            return np.repeat(np.arange(n), k), [pa.array([*A.BAND_BODIES] * n, pa.string()), pa.array(energy.ravel(), mask=lacks.ravel())]

        return _in_place(active, key, "band string, energy double", each)
    band = F.lit(None).cast("string")
    for name, bodies in A.BAND_BODIES.items():
        band = F.when(F.col("body_id").isin([A.ENTITIES.index(b) for b in bodies]), name).otherwise(band)
    return active.withColumn("band", band).where("band is not null").groupBy(key, "band").agg(F.sum("activation").alias("energy"))


def dominant_aspects(pair: DataFrame, key: str = "jd", top: int = 5, least: float = 0.4) -> DataFrame:
    """The strongest aspects of each instant, from pairs, or from skies (key, lons) in place; strengths that agree to nine digits go in order of bodies and aspects."""
    names = [*A.CONSTRUCTIVE, *A.DESTRUCTIVE]
    angle = {**A.CONSTRUCTIVE, **A.DESTRUCTIVE}
    each = F.array(*[F.struct(F.lit(n).alias("aspect"), F.lit(i).alias("order"), A.kernel(F.col("sep"), F.lit(angle[n])).alias("k")) for i, n in enumerate(names)])
    kind = F.when(F.col("aspect").isin(list(A.CONSTRUCTIVE)), "constructive").otherwise("destructive")
    if "lons" in pair.columns:

        def best(sky: _Sky):
            row, pairs_, aspect, strength, rank = sky.strongest(top, least)
            ends = [pa.array(x[pairs_].astype(np.int32)) for x in (_FIRST, _SECOND)]
            return row, [*ends, pa.array(np.array(names, object)[aspect], pa.string()), pa.array(sky.sep[row, pairs_]), pa.array(strength), pa.array(rank.astype(np.int32))]

        return _in_place(pair, key, "a int, b int, aspect string, sep double, strength double, rank int", best).withColumn("kind", kind)
    found = pair.where("w > 0").select(key, "a", "b", "sep", "w", F.explode(each).alias("x")).where(F.col("x.k") > least)
    found = found.select(key, "a", "b", F.col("x.aspect").alias("aspect"), "sep", (F.col("x.k") * F.col("w")).alias("strength"), F.col("x.order").alias("order"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("strength", 9)), "a", "b", "order"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("kind", kind).drop("order")


def stellium(rows: DataFrame, key: str = "jd") -> DataFrame:
    """(key, concentration, mean_deg): weighted circular mean of the bodies' longitudes."""
    w = weights()[F.col("body_id")]
    sums = rows.groupBy(key).agg(F.sum(w * F.cos("lon")).alias("c"), F.sum(w * F.sin("lon")).alias("s"), F.sum(w).alias("w"))
    return sums.select(key, (F.hypot("c", "s") / F.col("w")).alias("concentration"), F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("mean_deg"))


def stations(rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Planets that almost stand still: |speed| under so many degrees a day."""
    return rows.where(F.col("body").isin(list(A.STATIONING)) & (F.degrees(F.abs("lon_rate")) < threshold))


def eclipses(rows: DataFrame, key: str = "jd") -> DataFrame:
    lon = lambda name: F.max(F.when(F.col("body_id") == A.ENTITIES.index(name), F.degrees("lon")))
    wide = rows.groupBy(key).agg(lon("Sun").alias("sun"), lon("Moon").alias("moon"), lon("Rahu").alias("rahu"))
    return wide.select(key, A.eclipse(F.col("sun"), F.col("moon"), F.col("rahu")).alias("e")).select(key, "e.*")


def signatures(rows: DataFrame, key: str = "jd") -> DataFrame:
    """One row per instant: resonance, tension, net, concentration, mean_deg, solar, lunar, is_eclipse, scan_score.

    All from the array of an instant's longitudes: rows are gathered once, and skies (key, lons) not at all.
    """
    sun, moon, rahu = (A.ENTITIES.index(b) for b in ("Sun", "Moon", "Rahu"))
    near = lambda x: np.exp(-0.5 * (x / A.ECLIPSE_ORB_DEG) ** 2)

    def each(sky: _Sky):
        around = [np.where(sky.lacks, 0.0, f(sky.lon) * A.WEIGHTS).sum(1) for f in (np.cos, np.sin)]
        phase, node = sky.fold(sun, moon), sky.fold(moon, rahu)
        node = near(np.minimum(node, np.abs(node - 180)))
        lacks = sky.lacks[:, [sun, moon, rahu]].any(1)
        return None, [*sky.field(), *[pa.array(x, mask=sky.lacks.all(1)) for x in around], *[pa.array(near(x) * node, mask=lacks) for x in (phase, phase - 180)]]

    sums = _in_place(skies(rows, key), key, "resonance double, tension double, _c double, _s double, solar double, lunar double", each)
    made = sums.select(
        key, "resonance", "tension", (F.col("resonance") - F.col("tension")).alias("net"), (F.hypot("_c", "_s") / sum(A.WEIGHTS)).alias("concentration"),
        F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)).alias("mean_deg"), "solar", "lunar", (F.greatest("solar", "lunar") > 0.5).alias("is_eclipse"),
    )
    return made.withColumn("scan_score", F.col("tension") + 3 * F.greatest("solar", "lunar"))


#: Steps of a regular axis that are one window.
AXIS_BLOCK = 4096


def temporal_shear(signature: DataFrame, step_days: float, key: str = "jd") -> DataFrame:
    """Central difference of (resonance, tension, concentration) on a regular axis, per day; ends have none.

    Neighbours meet by their place on the axis in blocks of it, to which the steps beside a block are added, so the axis may be
    of any length and each signature is made once.
    """
    parts = ["resonance", "tension", "concentration"]
    placed = signature.withColumn("_i", F.rint(F.col(key) / step_days).cast("long"))
    block = lambda by: F.floor((F.col("_i") + by) / AXIS_BLOCK)
    seen = placed.withColumn("_own", block(0)).withColumn("_block", F.explode(F.array_distinct(F.array(block(-1), block(0), block(1)))))
    beside = lambda c, by: F.max(c).over(Window.partitionBy("_block").orderBy("_i").rangeBetween(by, by))
    wide = seen.withColumns({f"_{c}{tag}": beside(c, by) for c in parts for by, tag in ((-1, "a"), (1, "b"))}).where("_block = _own")
    square = sum((F.pow(F.col(f"_{c}b") - F.col(f"_{c}a"), F.lit(2.0)) for c in parts), F.lit(0.0))
    return wide.select(*signature.columns, (F.sqrt(square) / (2 * step_days)).alias("shear"))


def project(rows: DataFrame, mesh: DataFrame) -> DataFrame:
    """The topocentric field: (jd, node, body_id, north, east, up, cos_asc, sin_asc) of each instant, observer and body.

    rows: the global state, computed once per instant. The mesh is small by design and is broadcast.
    """
    eps = obliquity(F.col("jd"))
    r = F.col("r")
    sky = rows.select(
        "jd", "body_id", eps.alias("eps"), F.radians(gmst_deg(F.col("jd"))).alias("gmst"),
        (r * F.col("x")).alias("ex"), (r * (F.col("y") * F.cos(eps) - F.col("z") * F.sin(eps))).alias("ey"), (r * (F.col("y") * F.sin(eps) + F.col("z") * F.cos(eps))).alias("ez"),
    )
    both = sky.crossJoin(F.broadcast(mesh.select("node", F.col("lat").alias("phi"), "lon"))).withColumn("ramc", F.pmod(F.col("gmst") + F.col("lon"), F.lit(2 * 3.141592653589793)))
    near = F.when(F.col("body_id") < N_PHYSICAL, EARTH_AU).otherwise(0.0)
    phi, ramc = F.col("phi"), F.col("ramc")
    both = both.withColumns({"tx": F.col("ex") - near * F.cos(phi) * F.cos(ramc), "ty": F.col("ey") - near * F.cos(phi) * F.sin(ramc), "tz": F.col("ez") - near * F.sin(phi)})
    both = both.withColumn("tr", F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz")))
    both = both.withColumns({"dec": F.asin(clamp(F.col("tz") / F.col("tr"), -1.0, 1.0)), "h": ramc - F.atan2("ty", "tx")})
    dec, h, eps = F.col("dec"), F.col("h"), F.col("eps")
    up = clamp(F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(h), -1.0, 1.0)
    lon = F.atan2(F.col("ty") * F.cos(eps) + F.col("tz") * F.sin(eps), F.col("tx"))
    away = wrap_angle(lon - ascendant(ramc, eps, phi))
    return both.select(
        "jd", "node", "body_id",
        (F.sin(dec) * F.cos(phi) - F.cos(dec) * F.sin(phi) * F.cos(h)).alias("north"), (-F.cos(dec) * F.sin(h)).alias("east"), up.alias("up"),
        F.cos(away).alias("cos_asc"), F.sin(away).alias("sin_asc"),
    )


def local_intensity(field: DataFrame, active: DataFrame) -> DataFrame:
    """(jd, node, potential): bodies near the ascendant and up, by weight and activation."""
    w = weights()[F.col("body_id")]
    above = 0.5 * (F.col("up") + 1)
    angular = 0.5 * (F.col("cos_asc") + 1) * (0.5 + 0.5 * above)
    joined = field.join(F.broadcast(active), ["jd", "body_id"])
    return joined.groupBy("jd", "node").agg(F.sum(angular * w * (1 + F.col("activation"))).alias("potential"))


def map_shear(potential: DataFrame, dt_days: float = 1 / 24) -> DataFrame:
    """|difference to the instant dt later| / dt; instants without one go. The later instants are matched on their rounded minute."""
    minute = lambda c: F.rint(c * 1440).cast("long")
    here = potential.withColumn("_m", minute(F.col("jd")))
    there = potential.select("node", (minute(F.col("jd") - dt_days)).alias("_m"), F.col("potential").alias("_p"))
    return here.join(there, ["node", "_m"]).select("jd", "node", "potential", (F.abs(F.col("_p") - F.col("potential")) / dt_days).alias("shear"))


def subsolar(rows: DataFrame) -> DataFrame:
    """(jd, lat, lon) where the Sun stands overhead, in radians."""
    sun = rows.where("body_id = 0")
    eps = obliquity(F.col("jd"))
    y = F.col("y") * F.cos(eps) - F.col("z") * F.sin(eps)
    z = F.col("y") * F.sin(eps) + F.col("z") * F.cos(eps)
    return sun.select("jd", F.asin(clamp(z, -1.0, 1.0)).alias("lat"), wrap_angle(F.atan2(y, F.col("x")) - F.radians(gmst_deg(F.col("jd")))).alias("lon"))


def velocity(rows: DataFrame, key: str = "jd") -> DataFrame:
    """(key, velocity): change of the bodies' directions per hour since the instant before, as one norm."""
    along = Window.partitionBy("body_id").orderBy(key)
    d = lambda c: F.pow(F.col(c) - F.lag(c).over(along), F.lit(2.0))
    steps = rows.withColumn("_d", d("x") + d("y") + d("z")).withColumn("_t", (F.col(key) - F.lag(key).over(along)) * 24)
    return steps.where("_d is not null").groupBy(key).agg((F.sqrt(F.sum("_d")) / F.max("_t")).alias("velocity"))


def news_card(rows: DataFrame, key: str = "jd") -> DataFrame:
    """(key, bodies, aspect, applying): unit vectors and speeds of weighted bodies, the strongest aspect and whether it closes."""
    body = F.struct("body_id", "body", F.array("x", "y", "z").alias("unit_vector"), F.degrees("lon_rate").alias("deg_per_day"), "lon")
    bodies = rows.where(weights()[F.col("body_id")] > 0).groupBy(key).agg(F.sort_array(F.collect_list(body)).alias("bodies"))
    top = dominant_aspects(pairs(rows, key), key, top=1).drop("rank", "w")
    joined = bodies.join(top, key, "left")
    of = lambda c: F.filter("bodies", lambda x: x["body_id"] == F.col(c))[0]
    return joined.withColumn("applying", F.when(F.col("a").isNotNull(), A.is_applying(F.degrees(of("a")["lon"]), F.degrees(of("b")["lon"]), of("a")["deg_per_day"], of("b")["deg_per_day"])))
