"""A store's rows are computed once for a build, however many tiers and passes a write has."""

import os

from pyspark.sql import functions as F

from skyloom.sinks.store import TieredStore


def test_rows_are_computed_once_a_build(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    base = spark.range(600).selectExpr("2451545.0D + id / 3600 AS jd", "id AS frame", "id % 7 AS node", "id % 50 - 0.5D AS lat", "id % 90 - 0.5D AS lng", "id % 9 AS h3", "CAST(id % 5 AS INT) AS leaf", "CAST(id AS DOUBLE) AS potential", "1.0D AS shear", "id / 600 AS share")
    rows = base.withColumn("rarity", counted.asNondeterministic()("share")).drop("share")
    s = TieredStore(spark, str(tmp_path))
    s.build(rows, block="a")
    assert seen.value == 600
    assert s.read("tier1").count() == 600 and s.read("tier3").agg(F.sum("anomaly_count")).first()[0] == 60
    for tier in ("tier1", "tier2", "tier3"):
        assert spark.read.parquet(f"{s.root}/manifest/{tier}").agg(F.sum("n")).first()[0] == s.read(tier).count()
    # One tier alone, too; nothing of the passing tables stays.
    s.write("tier1", rows, block="b")
    assert seen.value == 1200 and s.read("tier1").count() == 1200
    assert not [f for _, _, files in os.walk(tmp_path / "passing") for f in files]
