"""Session settings and the one-row provenance check."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

#: Meaning of the projected columns; 2 is topocentric.
PROJECTION_VERSION = 2


def session(app: str = "skyloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; sizes such as shuffle partitions are the caller's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder where that is unset and the session is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def check_projection(meta: DataFrame, override: bool = False) -> int:
    """The projection version of a store; an error if it is not the engine's, unless overridden."""
    row = meta.select("projection_version").first()
    version = int(row[0]) if row is not None and row[0] is not None else 1
    if version != PROJECTION_VERSION and not override:
        raise ValueError(f"the store holds projection version {version}, this engine writes {PROJECTION_VERSION}")
    return version
