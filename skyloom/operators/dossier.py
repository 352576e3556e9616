"""The dossier of every token: activation logs in, profile and relation tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.calendar import day_index
from skyloom.operators import along
from skyloom.operators.relation import conditional
from skyloom.operators.sequence import persistence, top_per_group
from skyloom.operators.statistics import completed, correlations, dominant_period, fano

TOP_K, EPOCH_DAYS = 8, 50 * 365.25
#: Columns that lite mode leaves null.
RELATION_COLUMNS = ("transition_top_to", "transition_top_prob", "exclusion_top_token", "exclusion_top_corr", "symbiosis_top_token", "symbiosis_top_prob", "antipode_top_token", "antipode_top_prob")


def daily_volume(log: DataFrame) -> DataFrame:
    """(day_index, token_id, volume): how many nodes hold each token in the first frame of each day."""
    first = log.withColumn("day_index", day_index(F.col("jd")))
    opening = first.groupBy("day_index").agg(F.min("frame_ord").alias("_f"))
    return first.join(F.broadcast(opening), "day_index").where("frame_ord = _f").groupBy("day_index", "token_id").agg(F.count("*").alias("volume"))


def dead_letters(rows: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose values are all finite, and the others."""
    bad = None
    for v in values:
        x = F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        bad = x if bad is None else bad | x
    return rows.where(~bad), rows.where(bad)


def drift(log: DataFrame, mesh: DataFrame) -> DataFrame:
    """(token_id, velocity, lat_mean_deg, lat_std_deg): mean speed of each token's centroid in degrees a day, and its latitudes."""
    at = log.join(F.broadcast(mesh.select(F.col("node").alias("node_id"), "x", "y", "z", "lat_deg")), "node_id")
    spread = at.groupBy("token_id").agg(F.avg("lat_deg").alias("lat_mean_deg"), F.stddev_pop("lat_deg").alias("lat_std_deg"), F.avg(F.abs("lat_deg")).alias("lat_abs_deg"))
    c = at.groupBy("token_id", "frame_ord", "jd").agg(*[F.avg(a).alias(a) for a in "xyz"])
    c = c.withColumn("n", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).where("n >= 1e-9")
    c = c.select("token_id", "jd", *[(F.col(a) / F.col("n")).alias(a) for a in "xyz"])
    along = Window.partitionBy("token_id").orderBy("jd")
    dot = sum((F.col(a) * F.lag(a).over(along) for a in "yz"), F.col("x") * F.lag("x").over(along))
    step = F.degrees(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))) / F.nullif(F.col("jd") - F.lag("jd").over(along), F.lit(0.0))
    speed = c.withColumn("v", step).groupBy("token_id").agg(F.avg("v").alias("velocity"))
    return spread.join(speed, "token_id", "left")


def top_one(df: DataFrame, key: str, other: str, value: str, prefix: str, suffix: str, name: str = "token", largest: bool = True) -> DataFrame:
    order = F.desc(value) if largest else F.asc(value)
    best = top_per_group(df, key, 1, order, other)
    return best.select(F.col(key).alias("token_id"), F.col(other).alias(f"{prefix}_top_{name}"), F.col(value).alias(f"{prefix}_top_{suffix}"))


def build(spark: SparkSession, log: DataFrame, edges: DataFrame, antipodes: DataFrame, vocabulary: int, lite: bool = False) -> dict[str, DataFrame]:
    """All tables: tokens, transitions, exclusion, symbiosis, antipode. log: (frame_ord, jd, node_id, token_id)."""
    volume = daily_volume(log)
    days, tokens = volume.select("day_index").distinct(), volume.select("token_id").distinct()
    counts = log.groupBy("token_id").agg(F.count("*").alias("activations"), F.countDistinct("frame_ord").alias("frames_present"))
    by_day = log.withColumn("_day", F.floor("jd"))
    stay = persistence(along.runs(by_day, "node_id", "_day", ["frame_ord"], "token_id"), "token_id").withColumnsRenamed({"mean_run": "dwell_frames_mean", "max_run": "dwell_frames_max"})
    period = dominant_period(volume, "token_id", "day_index", "volume")
    epochs = volume.withColumn("epoch", F.floor(F.col("day_index") / EPOCH_DAYS)).groupBy("token_id", "epoch").agg(F.sum("volume").alias("v"))
    ages = spark.range(1).crossJoin(epochs.agg(F.min("epoch").alias("a"), F.max("epoch").alias("b"))).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("epoch"))
    burst = fano(completed(epochs, tokens, ages, "v"), "token_id", "v").withColumnRenamed("fano", "fano_factor")
    spine = spark.range(vocabulary).select(F.col("id").cast(log.schema["token_id"].dataType).alias("token_id"))
    profiles = [counts, stay, period, burst]
    if lite:
        empty = lambda schema: spark.createDataFrame([], schema)
        out = {
            "transitions": empty("prev int, token_id int, n long, probability double, rank int"), "exclusion": empty("token_id int, other int, corr double, rank int"),
            "symbiosis": empty("a int, b int, n long, probability double, rank int"), "antipode": empty("a int, b int, n long, probability double, rank int"),
        }
        dossier = spine
        for p in profiles:
            dossier = dossier.join(p, "token_id", "left")
        return {"tokens": dossier.withColumns({c: F.lit(None).cast("double") for c in RELATION_COLUMNS}), **out}
    moves = top_per_group(along.transitions(by_day, "node_id", "_day", ["frame_ord"], "token_id"), "prev", TOP_K, F.desc("n"), "token_id")
    corr = correlations(completed(volume, days, tokens, "volume"), "day_index", "token_id", "volume")
    both = corr.select(F.col("a").alias("token_id"), F.col("b").alias("other"), "corr").union(corr.select("b", "a", "corr"))
    against = top_per_group(both.where("corr < 0"), "token_id", TOP_K, F.asc("corr"), "other")
    beside = conditional(neighbour_counts(log, edges), TOP_K)
    across = conditional(neighbour_counts(log, antipodes), TOP_K)
    profiles += [
        top_one(moves.drop("rank"), "prev", "token_id", "probability", "transition", "prob", "to"),
        top_one(against.drop("rank"), "token_id", "other", "corr", "exclusion", "corr", largest=False),
        top_one(beside.drop("rank"), "a", "b", "probability", "symbiosis", "prob"),
        top_one(across.drop("rank"), "a", "b", "probability", "antipode", "prob"),
    ]
    dossier = spine
    for p in profiles:
        dossier = dossier.join(p, "token_id", "left")
    return {"tokens": dossier, "transitions": moves, "exclusion": against, "symbiosis": beside, "antipode": across}


def neighbour_counts(log: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n) over (src, dst) edges of one mesh, frame by frame."""
    here = log.select("frame_ord", F.col("node_id").alias("src"), F.col("token_id").alias("a"))
    there = log.select("frame_ord", F.col("node_id").alias("dst"), F.col("token_id").alias("b"))
    joined = here.join(F.broadcast(edges.select("src", "dst")), "src").join(there, ["frame_ord", "dst"])
    return joined.groupBy("a", "b").agg(F.count("*").alias("n"))


def write(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
