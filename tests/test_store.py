import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import api
from skyloom.functions.calendar import frame_to_jd
from skyloom.functions.cells import cell_of
from skyloom.operators.viewport import Viewport, at_point, common_names, route, superset, tier_for, viewport, year_of
from skyloom.session import check_projection
from skyloom.sinks.store import TieredStore, pending, read_wire_frame, wire_frame
from skyloom.sources import chunks
from skyloom.sources.mesh import fibonacci
from skyloom.sources.tables import read_or_empty

START = 67_090_000_0


@pytest.fixture(scope="module")
def rows(spark):
    mesh = fibonacci(spark, 4).select("node", F.col("lat_deg").cast("float").alias("lat"), F.col("lng_deg").cast("float").alias("lng"))
    frames = spark.range(START, START + 2 * 3600 + 10, 20).select(F.col("id").alias("frame"), frame_to_jd(F.col("id")).alias("jd"))
    at = frames.crossJoin(mesh)
    h = F.pmod(F.xxhash64("frame", "node"), F.lit(1000)) / 1000.0
    return at.select(
        "jd", "frame", "node", "lat", "lng", cell_of(F.col("lat"), F.col("lng")).alias("h3"), F.floor(h * 64).cast("int").alias("macro"), F.floor(h * 17).cast("int").alias("micro"),
        F.floor(h * 4096).cast("int").alias("leaf"), (h * 2).cast("float").alias("potential"), (h / 3).cast("float").alias("shear"), h.cast("float").alias("rarity"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.when(h > 0.5, 10.0).otherwise(-10.0) + i / 100 + h / 100).cast("float")).alias("latent"),
    ).cache()


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    s = TieredStore(spark, f"file://{tmp_path_factory.mktemp('store')}")
    s.build(rows)
    return s


def test_router():
    assert [tier_for(f / 3600) for f in (500, 50_000, 500_000_000)] == ["tier1", "tier2", "tier3"]
    assert tier_for(100.0, velocity=1000) == "tier1"
    assert route(10_000.0, 1, {"tier1", "tier2"}) == "tier2" and route(0.01, 1, {"tier3"}) == "tier3"
    with pytest.raises(ValueError):
        route(1, 1, set())


def test_year_of_agrees_with_the_column(spark):
    from skyloom.functions.calendar import jd_to_gregorian

    for r in spark.range(0, 5_000_000, 99_991).select((F.col("id") + 0.4).alias("jd")).select("jd", jd_to_gregorian(F.col("jd"))["year"].alias("y")).collect():
        assert year_of(r.jd) == r.y


def test_tiers(store, rows):
    assert store.present() == {"tier1", "tier2", "tier3"}
    hours, days = store.read("tier2"), store.read("tier3")
    assert hours.count() == 4 * 49 and days.count() == 4 * 3
    assert hours.agg(F.max("rarity")).first()[0] == rows.agg(F.max("rarity")).first()[0]
    assert days.agg(F.sum("anomaly_count")).first()[0] == rows.where("rarity >= 0.9").count()
    assert {"mean_rarity", "std_potential", "mean_potential"} <= set(days.columns)


def test_a_second_build_changes_nothing(store, rows):
    before = store.read("tier1").count()
    store.build(rows)
    assert store.read("tier1").count() == before == rows.count()


def test_sparse_is_a_subset(spark, rows, tmp_path):
    s = TieredStore(spark, f"file://{tmp_path}/sparse")
    s.build(rows, rarity_min=0.95)
    assert s.read("tier1").count() == rows.where("rarity >= 0.95").count() and s.read("tier3").count() == 12


def test_viewport_order_pruning_and_limits(store, rows):
    jd = frame_jd = rows.agg(F.min("jd")).first()[0]
    v = Viewport(jd, frame_jd + 0.25, rarity_min=0.3, limit=50)
    tier, got = store.query(v)
    got_rows = got.collect()
    assert tier == "tier1" and len(got_rows) == 50 and [r.rarity for r in got_rows] == sorted((r.rarity for r in got_rows), reverse=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(century" in plan and "PushedFilters: [IsNotNull(" in plan and "TakeOrderedAndProject" in plan
    far, _ = store.query(Viewport(jd, jd + 4_000_000))
    assert far == "tier3"
    south = viewport(store.read("tier1"), Viewport(jd, jd + 3, max_lat=-20.0)).collect()
    assert south and all(r.lat <= -16 for r in south)
    with pytest.raises(ValueError):
        Viewport(2.0, 1.0)
    with pytest.raises(ValueError):
        Viewport(1.0, 2.0, limit=0)


def _scanned(df):
    """Rows that the scans of a collected frame gave."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        kids = inner or [node.children().apply(i) for i in range(node.children().size())]
        todo += kids
        got = node.metrics().get("numOutputRows") if not kids else None
        out += got.get().value() if got is not None and got.isDefined() else 0
    return out


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """120,000 rows of 20 days on a lattice of places, in two blocks."""
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    base = spark.range(120_000).withColumns({"r": h, "day": F.pmod(F.hash("id"), F.lit(1_728_000)) / 86_400.0})
    lat, lng = (F.pmod(F.col("id") * 7, F.lit(170)) - 85).cast("double"), (F.pmod(F.col("id") * 13, F.lit(350)) - 175).cast("double")
    rows = base.select((F.col("day") + 2460310.5).alias("jd"), F.floor(F.col("day") * 3600).alias("frame"), F.col("id").alias("node"), lat.alias("lat"), lng.alias("lng"), cell_of(lat, lng).alias("h3"), F.lit(1).alias("leaf"), F.col("r").alias("potential"), F.col("r").alias("shear"), F.col("r").alias("rarity")).cache()
    s = TieredStore(spark, f"file://{tmp_path_factory.mktemp('many')}")
    s.write("tier1", rows.where("day < 10"), "first")
    s.write("tier1", rows.where("day >= 10"), "second")
    return s, rows


@pytest.mark.parametrize(
    "v, most",
    [
        (Viewport(2460310.5, 2460330.5, limit=300), 2000),
        (Viewport(2460312.0, 2460313.0, limit=300), 6000),
        (Viewport(2460312.0, 2460312.01, limit=300), 12000),
        (Viewport(2460311.0, 2460329.0, -40.0, 170.0, 40.0, -150.0, 0.2, 200), 120000),
        (Viewport(2460311.0, 2460329.0, 10.0, 10.0, 20.0, 30.0, limit=1000), 60000),
        (Viewport(2460311.0, 2460329.0, rarity_min=0.9999, limit=1000), 3000),
    ],
)
def test_a_viewport_reads_few_rows_and_loses_none(many, v, most):
    s, rows = many
    got = viewport(s.read("tier1"), s.narrowed("tier1", v))
    found = [(r.rarity, r.jd, r.node) for r in got.collect()]
    want = [(r.rarity, r.jd, r.node) for r in viewport(rows.withColumn("century", F.lit(20)), v).collect()]
    assert found == want
    assert _scanned(got) <= most


def test_the_manifest_follows_its_blocks(spark, tmp_path):
    s = TieredStore(spark, f"file://{tmp_path}")
    made = lambda n, r: spark.range(n).selectExpr("2451545.0 + id / 100 AS jd", "id AS frame", "id AS node", "0.0D AS lat", "0.0D AS lng", "1L AS h3", f"{r}D + id / 1e6 AS rarity")
    s.write("tier1", made(2000, 0.5), "a")
    s.write("tier1", made(1000, 0.1), "b")
    s.write("tier1", made(10, 0.7), "a")
    kept = spark.read.parquet(f"{s.root}/manifest/tier1")
    assert kept.agg(F.sum("n")).first()[0] == s.read("tier1").count() == 1010
    v = Viewport(2451545.0, 2451600.0, limit=10)
    assert s.narrowed("tier1", v).rarity_min == 0.7 and s.narrowed("tier1", Viewport(2451545.0, 2451600.0, limit=5000)).rarity_min == 0.0
    assert "brick" not in s.read("tier1").columns


def test_point_and_superset(store, rows):
    one = rows.first()
    best = at_point(store.read("tier1"), one.lat, one.lng, one.jd).first()
    assert best.rarity >= one.rarity
    both = common_names(superset(store.read("tier1"), store.read("tier3")))
    assert both.count() == store.read("tier1").count() + 12 and both.where("potential is null").count() == 0


def test_inspect(store, rows):
    jd = rows.agg(F.min("jd")).first()[0]
    got = api.inspect(store, Viewport(jd, jd + 0.2, limit=120))
    out = got["rows"].collect()
    assert got["tier"] == "tier1" and len(got["global_latent"]) == 8 and out and all(r.cluster_id >= -1 for r in out)
    assert "latent" not in got["rows"].columns and set(got["band_gains"]) == {"micro", "fast", "cyclic", "macro"}
    assert api.status(store)["tiers"] == ["tier1", "tier2", "tier3"]
    news = api.news(store, Viewport(jd, jd + 0.2), top=3).collect()
    assert 0 < len(news) <= 3 and all(r.rarity * 100 >= 95 and len(r.bodies) == 9 for r in news)


def test_provenance(spark):
    old = spark.createDataFrame([(1,)], "projection_version int")
    with pytest.raises(ValueError):
        check_projection(old)
    assert check_projection(old, override=True) == 1


def test_absent_tables_are_empty(spark, tmp_path):
    assert read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0


def test_ledger(spark):
    assert [r.chunk for r in pending(spark.range(4).withColumnRenamed("id", "chunk"), spark.range(2).withColumnRenamed("id", "chunk")).orderBy("chunk").collect()] == [2, 3]


def test_wire_frames(rows):
    some = rows.limit(20).collect()
    for latent in (False, True):
        data = wire_frame(some, latent)
        got = read_wire_frame(data)
        assert np.allclose(got["rarity"], [r.rarity for r in some]) and got["micro"].tolist() == [r.micro for r in some] and ("latent" in got) == latent
    assert len(read_wire_frame(wire_frame([]))["lat"]) == 0
    with pytest.raises(ValueError):
        read_wire_frame(b"\0" * 16)


def test_bf16():
    x = np.array([0, 1, -1, 3.14159, 1e-3, 1e3, -273.15], np.float32)
    got = chunks.from_bf16(chunks.to_bf16(x))
    assert np.all(np.abs(got - x) <= np.abs(x) * 1e-2) and got[:3].tolist() == [0, 1, -1] and np.isnan(chunks.from_bf16(chunks.to_bf16(np.array([np.nan], np.float32))))[0]


def test_chunks_round_trip(spark, tmp_path):
    walk = np.cumsum(np.random.default_rng(0).normal(size=(24, 5)) * 0.01, axis=0).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(walk)], "frame long, state array<float>")
    packed = chunks.packed(df, 8)
    assert [r.start for r in packed.orderBy("start").collect()] == [0, 8, 16]
    back = chunks.unpacked(packed).orderBy("frame").collect()
    assert np.allclose([r.state for r in back], walk, atol=0.01)
    for r in packed.collect():
        (tmp_path / f"{r.start:08d}.chunk").write_bytes(bytes(r.content))
    assert chunks.read_chunk_files(spark, str(tmp_path)).count() == 24
    chunks.write_chunks(df, f"{tmp_path}/out", 8)
    assert list(chunks.manifest(f"{tmp_path}/out")) == [0, 8, 16]
    assert [(r.frame, r.state) for r in chunks.read_chunks(spark, f"{tmp_path}/out").orderBy("frame").collect()] == [(r.frame, r.state) for r in back]


def _numbers(spark, first, last, plus=0):
    return spark.range(first, last).selectExpr("id AS frame", f"array(CAST(id % 50 + {plus} AS FLOAT), CAST(id % 7 AS FLOAT)) AS state")


def test_chunk_writes_add_up_and_replace_themselves_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    value = lambda **w: {r.frame: r.state[0] for r in chunks.read_chunks(spark, path).collect()}
    chunks.write_chunks(_numbers(spark, 0, 640), path, 8)
    chunks.write_chunks(_numbers(spark, 640, 1280), path, 8)
    assert value() == {i: float(i % 50) for i in range(1280)}
    chunks.write_chunks(_numbers(spark, 80, 96, plus=3), path, 8)
    assert value() == {i: float(i % 50 + (3 if 80 <= i < 96 else 0)) for i in range(1280)}
    chunks.write_chunks(_numbers(spark, 0, 10), path, 8, overwrite=True)
    assert value() == {i: float(i) for i in range(10)}


def test_chunk_log_starts_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "LOG_SPAN", 3)
    writer = lambda i: chunks._ChunkWriter(str(tmp_path), False)
    for i in range(8):
        writer(i).commit([chunks._Written([{"start": i % 5, "frames": 1, "file": f"f{i}"}]), None])
    assert {k: v["file"] for k, v in chunks.manifest(str(tmp_path)).items()} == {0: "f5", 1: "f6", 2: "f7", 3: "f3", 4: "f4"}


def test_failed_chunk_writes_leave_nothing_to_see(spark, tmp_path):
    path = str(tmp_path / "store")
    chunks.write_chunks(_numbers(spark, 0, 32), path, 8)
    before = chunks.manifest(path)
    broken = _numbers(spark, 32, 96).withColumn("state", F.when(F.col("frame") == 90, F.expr("array(CAST(raise_error('lost') AS FLOAT))")).otherwise(F.col("state")))
    with pytest.raises(Exception, match="lost"):
        chunks.write_chunks(broken, path, 8)
    assert chunks.manifest(path) == before and chunks.read_chunks(spark, path).count() == 32


def test_chunk_filters_choose_files(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    chunks.write_chunks(_numbers(spark, 0, 800), path, 8)
    every = spark.read.format("skyloom_chunks").option("chunks_per_task", 1).load(path)
    for where, n, files in (("frame >= 780", 20, 3), ("frame BETWEEN 15 AND 17", 3, 2), ("frame = 100", 1, 1), ("frame IN (3, 500)", 2, 2), ("frame > 5 AND frame < 4", 0, 0), ("frame IS NULL", 0, 100)):
        found = every.where(where)
        assert found.count() == n
        assert found.rdd.getNumPartitions() == max(files, 1), where
    reader = chunks._ChunkReader(path, 30)
    assert len(reader.files()) == 100 and [len(p.names) for p in reader.partitions()] == [30, 30, 30, 10]


def test_blocks_of_a_century_add_up(spark, tmp_path):
    s = TieredStore(spark, str(tmp_path))
    rows = [spark.createDataFrame([(2451545.0 + d, d * 3600, n, 0.0, 0.0, 1, 7, 1.0, 0.5, 0.9) for d in days for n in range(3)], "jd double, frame long, node int, lat double, lng double, h3 long, leaf int, potential double, shear double, rarity double") for days in ((0, 1), (2, 3, 4))]
    s.build(rows[0], block="a")
    s.build(rows[1], block="b")
    s.build(rows[1], block="b")
    assert [s.read(t).count() for t in ("tier1", "tier2", "tier3")] == [15, 15, 15]
    s.build(rows[0].where("node = 0"), block="a")
    assert s.read("tier1").count() == 11
    # Rows without a block's name are a block of their own.
    for _ in range(2):
        s.build(rows[0].withColumn("node", F.col("node") + 10))
    assert [s.read(t).count() for t in ("tier1", "tier2", "tier3")] == [17, 17, 17]
    s.build(rows[0].where("node < 0"))
    assert s.read("tier1").count() == 17
