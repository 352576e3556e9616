"""What a service or a shell calls: viewport, news, micro-grid, telemetry, twins, readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.angles import dot
from skyloom.functions.aspects import BAND_PERIOD, band_gains, significance_percentile, temporal_stride
from skyloom.functions.calendar import FRAMES_PER_DAY, jd_or_datetime
from skyloom.operators import twin, weather
from skyloom.operators.density import density_clusters
from skyloom.operators.viewport import Viewport, at_point
from skyloom.sinks.store import TieredStore
from skyloom.sources.ephemeris import global_state
from skyloom.sources.mesh import microgrid as grid


def to_jd(spark: SparkSession, text: str) -> float:
    jd = spark.range(1).select(jd_or_datetime(F.lit(text))).first()[0]
    if jd is None:
        raise ValueError(f"neither a date nor a Julian Day: {text}")
    return jd


def instants(spark: SparkSession, *jds: float) -> DataFrame:
    return global_state(spark.createDataFrame([(float(j),) for j in jds], "jd double"))


def inspect(store: TieredStore, v: Viewport, clusters: bool = True) -> dict:
    """Rows with cluster ids, their mean latent, the tier that served them and the gain of each band."""
    tier, rows = store.query(v)
    gains = store.spark.range(1).select(band_gains(temporal_stride(F.lit(int((v.end - v.start) * FRAMES_PER_DAY)))).alias("g")).first()["g"]
    mean = None
    if "latent" in rows.columns:
        parts = rows.where("latent is not null").select(F.posexplode("latent").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
        mean = [r["x"] for r in parts.orderBy("i").collect()]
        if clusters:
            rows = density_clusters(rows, "latent", id="node").orderBy(F.desc("rarity"), "jd", "node")
        rows = rows.drop("latent")
    return {"tier": tier, "rows": rows, "global_latent": mean, "band_gains": {b: gains[b] for b in BAND_PERIOD}}


def news(store: TieredStore, v: Viewport, top: int = 10) -> DataFrame:
    """The rarest rows beyond the significance of the span, each with the geometry of its instant."""
    share = store.spark.range(1).select(significance_percentile(F.lit((v.end - v.start) / 365.25))).first()[0]
    _, rows = store.query(v)
    best = rows.where(F.col("rarity") * 100 >= share).orderBy(F.desc("rarity"), "jd", "node").limit(top)
    cards = weather.news_card(global_state(best.select("jd").distinct()))
    return best.drop(*[c for c in ("latent",) if c in best.columns]).join(cards, "jd").withColumn("rarity_percentile", F.col("rarity") * 100)


def reading(spark: SparkSession, jd: float) -> DataFrame:
    """The signature of an instant."""
    return weather.signatures(instants(spark, jd))


def heatmap(spark: SparkSession, jd: float, mesh: DataFrame, dt_days: float = 1 / 24) -> DataFrame:
    """Potential and shear of every node."""
    rows = instants(spark, jd, jd + dt_days)
    field = weather.project(rows, mesh)
    potential = weather.local_intensity(field, weather.activation(weather.pairs(rows)))
    return weather.map_shear(potential, dt_days).where(F.abs(F.col("jd") - jd) < 1e-9)


def microgrid(spark: SparkSession, box: tuple[float, float, float, float], jd: float, density: int) -> DataFrame:
    return heatmap(spark, jd, grid(spark, *box, density))


def point(spark: SparkSession, lat: float, lng: float, jd: float) -> DataFrame:
    """Potential and shear at one place."""
    here = spark.createDataFrame([(0, lat, lng)], "node int, lat_deg double, lng_deg double")
    return heatmap(spark, jd, here.select("node", F.radians("lat_deg").alias("lat"), F.radians("lng_deg").alias("lon")))


def telemetry(store: TieredStore, lat: float, lng: float, jd: float) -> DataFrame:
    """The rarest row near a place and time."""
    return at_point(store.read("tier1"), lat, lng, jd)


def scan(spark: SparkSession, days: DataFrame, top: int = 10) -> DataFrame:
    """Instants of most tension and eclipse."""
    return weather.signatures(global_state(days)).orderBy(F.desc("scan_score"), "jd").limit(top)


def similar(bank: DataFrame, vec: list[float], k: int) -> DataFrame:
    """The k rows of a bank (id, vec), unit vectors, of greatest dot product."""
    q = F.array(*[F.lit(float(x)) for x in vec])
    return bank.withColumn("score", dot(F.col("vec"), q)).orderBy(F.desc("score"), "id").limit(k)


def twins(spark: SparkSession, positions: DataFrame, jd: float, lat: float, lng: float, tier: int, **options) -> DataFrame:
    natal = twin.natal_key(spark, jd, lat, lng)
    return twin.with_places(twin.search(positions, natal, tier, **options), natal, tier, lat)


def status(store: TieredStore) -> dict:
    return {"tiers": sorted(store.present()), "spark": store.spark.version}
