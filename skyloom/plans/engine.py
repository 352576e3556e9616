"""Registered queries of the store, the streams, the SQL names and the graph kernels, each with its SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from skyloom.functions.cells import cell_of
from skyloom.operators import codebook, curriculum, kernels, relation, sketch, statistics, sweep, transducer
from skyloom.operators.viewport import Viewport
from skyloom.plans import registry
from skyloom.plans.probes import _UNIT, _vectors, query
from skyloom.session import shared_folder
from skyloom.sinks.store import TieredStore, read_wire_frame, wire_frame
from skyloom.sources import chunks, triangles
from skyloom.sources.tables import table
from skyloom.streaming import ordered, rollups


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/skyloom/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------------- store

_ROWS = """f AS (SELECT CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 24) AS BIGINT) AS frame, user_id AS node, (user_id % 100 - 50)::DOUBLE AS lat, (user_id % 300 - 150)::DOUBLE AS lng, ascii(event_type) AS leaf, value, event_id FROM events),
t AS (SELECT 2460310.5::DOUBLE + frame::DOUBLE / 3600 AS jd, * FROM f), z AS (SELECT min(frame) AS first FROM t)"""


def _tier_rows(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = table(spark, d, "events").withColumn("frame", F.floor(seconds / 24).cast("long"))
    lat, lng = (F.col("user_id") % 100 - 50).cast("double"), (F.col("user_id") % 300 - 150).cast("double")
    return rows.select(
        (F.lit(2460310.5) + F.col("frame").cast("double") / 3600).alias("jd"), "frame", F.col("user_id").alias("node"), lat.alias("lat"), lng.alias("lng"), cell_of(lat, lng).alias("h3"),
        F.ascii("event_type").alias("leaf"), F.col("value").alias("potential"), (F.col("value") / 2).alias("shear"), (F.col("value") / 512).alias("rarity"), "event_id",
    )


def _store(spark, d) -> TieredStore:
    """The events as a store, written in two blocks that add up."""
    store, rows = TieredStore(spark, _folder(spark, "store")), _tier_rows(spark, d)
    whole = F.floor(F.col("frame") / 3600) * 3600
    half = F.lit(15 * 3600)
    store.build(rows.where(whole < half), block="first")
    store.build(rows.where(whole >= half), block="second")
    return store


_MODE = """m AS (SELECT node, b, leaf AS archetype FROM (SELECT node, b, leaf, row_number() OVER (PARTITION BY node, b ORDER BY count(*) DESC, leaf) AS k FROM x GROUP BY node, b, leaf) WHERE k = 1)"""
_HALVES = "h AS (SELECT t.*, CASE WHEN frame // 3600 < 15 THEN 0 ELSE 1 END AS half FROM t), q AS (SELECT half, min(frame) AS first FROM h GROUP BY half)"


@query(f"WITH {_ROWS} SELECT node, jd, leaf, round(value, 6) AS potential FROM t")
def store_tier1(spark, d):
    return _store(spark, d).read("tier1").select("node", "jd", "leaf", F.round("potential", 6).alias("potential"))


@query(f"""WITH {_ROWS}, {_HALVES}, x AS (SELECT h.*, h.half * 1000000 + (frame - q.first) // 3600 AS b FROM h JOIN q ON q.half = h.half), {_MODE}, g AS (SELECT node, b, min(jd) AS jd, max(value) AS max_potential, avg(value) AS mean_potential, count(*) FILTER (value / 512 >= 0.9) AS anomaly_count FROM x GROUP BY node, b)
SELECT g.node, jd, round(max_potential, 6) AS max_potential, round(mean_potential, 6) AS mean_potential, anomaly_count, archetype FROM g JOIN m ON m.node = g.node AND m.b = g.b""")
def store_tier3(spark, d):
    rows = _store(spark, d).read("tier3")
    return rows.select("node", "jd", F.round("max_potential", 6).alias("max_potential"), F.round("mean_potential", 6).alias("mean_potential"), "anomaly_count", "archetype")


@query(f"""WITH {_ROWS}, {_HALVES}, x AS (SELECT h.*, h.half * 1000000 + (frame - q.first) // 150 AS b FROM h JOIN q ON q.half = h.half), g AS (SELECT node, b, min(jd) AS jd, max(value) AS v FROM x GROUP BY node, b)
SELECT node, jd, round(v, 6) AS max_potential FROM g WHERE jd BETWEEN 2460312 AND 2460330 AND v / 512 >= 0.125 AND node % 100 - 50 BETWEEN -50 AND -23 ORDER BY v DESC, jd, node LIMIT 300""")
def store_viewport(spark, d):
    """A span of eighteen days is served by the hourly tier."""
    tier, rows = _store(spark, d).query(Viewport(2460312.0, 2460330.0, -50.0, -180.0, -22.5, 179.9, 0.125, 300))
    return rows.where(F.lit(tier) == "tier2").select("node", "jd", F.round("max_potential", 6).alias("max_potential"))


@query(f"WITH {_ROWS} SELECT node, round(value, 2) AS potential FROM t WHERE value >= 100 ORDER BY value DESC, event_id LIMIT 100")
def wire_frames(spark, d):
    """The strongest rows as bytes and back."""
    rows = _tier_rows(spark, d).where("potential >= 100").orderBy(F.desc("potential"), "event_id").limit(100)
    got = rows.select("node", "lat", "lng", "potential", "rarity", (F.col("leaf") / 64).cast("int").alias("macro"), (F.col("leaf") % 64).alias("micro")).collect()
    back = read_wire_frame(wire_frame(got))
    return spark.createDataFrame([(r.node, float(round(float(x), 2))) for r, x in zip(got, back["potential"], strict=True)], "node long, potential double")


@query("SELECT p_partkey AS frame, unnest(range(3)) AS place, unnest([p_size, p_partkey % 17, length(p_name)])::DOUBLE AS x FROM part")
def chunk_frames(spark, d):
    """A part's numbers as a frame, written as chunks in two halves, the first one twice, and read again; differences this small survive bfloat16."""
    state = F.array(*[F.col(c).cast("float") for c in ("p_size", "m", "l")])
    rows = table(spark, d, "part").withColumns({"m": F.col("p_partkey") % 17, "l": F.length("p_name")}).select(F.col("p_partkey").alias("frame"), state.alias("state"))
    path = _folder(spark, "chunks")
    early = F.floor(F.col("frame") / 64) % 2 == 0
    for half in (rows.where(early), rows.where(~early), rows.where(early)):
        chunks.write_chunks(half, path, 64)
    return chunks.read_chunks(spark, path).select("frame", F.posexplode("state").alias("place", "x")).select("frame", F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("x"))


# ------------------------------------------------------------------------------ sweeps

_SWEPT = ["value", "hour", "node"]


@query("""WITH x AS (SELECT event_type, value::DOUBLE AS value, hour(ts)::DOUBLE AS hour, (user_id % 7)::DOUBLE AS node, 1 + user_id % 3 AS w FROM events WHERE isfinite(value)),
p AS (SELECT event_type, count(*) AS n, sum(w)::DOUBLE AS w, [sum(w * value), sum(w * hour), sum(w * node)] AS s, [sum(w * value * value), sum(w * value * hour), sum(w * value * node), sum(w * hour * hour), sum(w * hour * node), sum(w * node * node)] AS p FROM x GROUP BY event_type)
SELECT event_type, n, w, i, round(m, 4) AS total FROM (SELECT event_type, n, w, generate_subscripts(s || p, 1) - 1 AS i, unnest(s || p) AS m FROM p)""")
def sweep_moments(spark, d):
    """Weighted moments of the events by type, swept week by week; the sweep stops after the first weeks and is started again."""
    rows = table(spark, d, "events").select("event_type", "value", F.hour("ts").alias("hour"), (F.col("user_id") % 7).alias("node"), (1 + F.col("user_id") % 3).alias("w"), F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).alias("week"))
    swept = sweep.Sweep(spark, _folder(spark, "sweep"), ["event_type"], _SWEPT, "w")
    swept.run(rows.where("week < 2"), "week")
    swept.run(rows, "week")
    # Values have two decimals, so products have four: rounding meets no ties.
    each = swept.result().select("event_type", "n", "w", F.posexplode(F.concat("s", "p")).alias("i", "total"))
    return each.select("event_type", "n", "w", F.col("i").cast("long").alias("i"), F.round("total", 4).alias("total"))


# ------------------------------------------------------------------------ sketches

_SHARES = [0.5, 0.9, 0.95, 0.99, 0.999]


@query("""WITH x AS (SELECT event_type, value::DOUBLE AS x FROM events WHERE value IS NOT NULL),
b AS (SELECT event_type, CASE WHEN isnan(x) THEN 1073741825 WHEN isinf(x) THEN sign(x) * 1073741824 WHEN x = 0 THEN 0 ELSE sign(x) * (ceil(ln(abs(x)) / ln(1.01::DOUBLE / 0.99)) + 16777216) END AS bucket, count(*) AS n, min(x) AS low, max(x) AS high FROM x GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b), q AS (SELECT *, CAST(floor(share * (total - 1)::DOUBLE) AS BIGINT) AS rank FROM r, (SELECT unnest([0.5::DOUBLE, 0.9, 0.95, 0.99, 0.999]) AS share))
SELECT event_type, share, CAST(total AS BIGINT) AS n, round(greatest(least(sign(bucket) * exp((abs(bucket) - 16777216) * ln(1.01::DOUBLE / 0.99)) * 0.99, high), low), 6) AS estimate, low, high FROM q WHERE rank >= upto - n AND rank < upto""")
def value_sketches(spark, d):
    """High percentiles of the events' values by type from sketches kept by week, the first of which is written twice."""
    rows = table(spark, d, "events").withColumn("week", F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7))
    kept = sketch.Percentiles(spark, _folder(spark, "sketches"), ["event_type"], "value")
    for week in (0, 1, 2, 3, 0):
        kept.add(rows.where(F.col("week") == week), f"week-{week}")
    kept.add(rows.where("week < 0 or week > 3 or week is null"), "others")
    return kept.result(_SHARES).withColumn("estimate", F.round("estimate", 6))


# ----------------------------------------------------------------------------- streams


def _events(spark, d):
    """The events as a stream; a pattern, as a source of files takes no single file."""
    return rollups.event_stream(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)


def _drained(spark, stream, mode: str):
    name = f"drained_{uuid.uuid4().hex}"
    return rollups.run_once(stream, name, _folder(spark, "stream"), mode)


@query("SELECT user_id, date_trunc('hour', ts) AS hour, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark, d):
    rows = _drained(spark, rollups.windowed(_events(spark, d)), "complete")
    return rows.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("hour"), F.round("max_value", 6).alias("max_value"), F.round("mean_value", 6).alias("mean_value"), "n")


@query("SELECT s + INTERVAL 6 HOUR * k AS start, count(*) AS n FROM (SELECT date_trunc('day', ts) - INTERVAL 1 DAY AS s, ts FROM events), range(8) r(k) WHERE ts >= s + INTERVAL 6 HOUR * k AND ts < s + INTERVAL 6 HOUR * k + INTERVAL 1 DAY GROUP BY 1")
def stream_sliding(spark, d):
    rows = _drained(spark, rollups.sliding(_events(spark, d), "1 day", "6 hours"), "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_histogram(spark, d):
    return _drained(spark, rollups.running_histogram(_events(spark, d), "event_type"), "complete")


@query("""WITH a AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS g FROM events),
r AS (SELECT user_id, event_type, g, count(*) AS run_len, max(ts) AS last FROM a GROUP BY 1, 2, 3), z AS (SELECT *, last = max(last) OVER (PARTITION BY user_id) AS open FROM r)
SELECT event_type, run_len, count(*) AS n FROM z WHERE NOT open GROUP BY 1, 2""")
def stream_runs(spark, d):
    """Finished runs; each user's last one stays open as state."""
    return _drained(spark, rollups.run_lengths(_events(spark, d)), "append").groupBy("event_type", "run_len").agg(F.count("*").alias("n"))


#: Rows that lie behind the last watermark: their millisecond is over two hours before the last event's.
_BEHIND = "b AS (SELECT * FROM events WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 7200000)"


@query(f"""WITH {_BEHIND}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM b),
r AS (SELECT user_id, event_type, g, count(*) AS run_len, max(ts) AS last FROM a GROUP BY 1, 2, 3), z AS (SELECT *, last = max(last) OVER (PARTITION BY user_id) AS open FROM r)
SELECT user_id, event_type, run_len, count(*) AS n FROM z WHERE NOT open GROUP BY 1, 2, 3""")
def stream_ordered_runs(spark, d):
    """Runs that ended behind the watermark, whatever the order in which events came."""
    rows = _drained(spark, ordered.run_lengths(_events(spark, d)), "append")
    return rows.groupBy("user_id", "event_type", "run_len").agg(F.count("*").alias("n"))


@query(f"""WITH {_BEHIND} SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, round(value - lag(value) OVER w, 4) AS change FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stream_steps(spark, d):
    """Each event with what has passed since its user's event before."""
    rows = _drained(spark, ordered.steps(_events(spark, d)), "append")
    return rows.select("user_id", F.col("tie").alias("event_id"), "gap", F.round("change", 4).alias("change"))


@query("""SELECT a.user_id, a.event_id AS click, b.event_id AS purchase, epoch_us(b.ts) - epoch_us(a.ts) AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR""")
def stream_join(spark, d):
    """Clicks and the purchases of the same user within six hours: two streams, both with watermarks."""
    clicks, purchases = (_events(spark, d).where(F.col("event_type") == kind) for kind in ("click", "purchase"))
    rows = _drained(spark, rollups.interval_join(clicks, purchases, "user_id", 6 * 3600), "append")
    return rows.select("user_id", F.col("event_id").alias("click"), F.col("event_id_right").alias("purchase"), (F.unix_micros("ts_right") - F.unix_micros("ts")).alias("gap"))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT event_type, sum(n) AS q FROM c GROUP BY 1), s AS (SELECT sum(q) AS total, count(*) AS kinds FROM k),
d AS (SELECT day, sum(n) AS n, count(*) AS n_tokens FROM c GROUP BY 1),
g AS (SELECT d.day, d.n, d.n_tokens, (coalesce(c.n, 0) + 0.5) / (d.n + s.kinds / 2) AS p, (k.q + 0.5) / (s.total + s.kinds / 2) AS q FROM d CROSS JOIN k CROSS JOIN s LEFT JOIN c ON c.day = d.day AND c.event_type = k.event_type)
SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n, n_tokens, round(sum(p * log2(p / q)), 8) AS bits FROM g GROUP BY 1, 2, 3""")
def stream_day_scores(spark, d):
    """Every day's mix of event types against that of all days, from counts that each batch adds to a table."""
    folder = _folder(spark, "scores")
    stream = _events(spark, d).withColumn("day", F.to_date("ts"))
    write = rollups.merge_into(folder, "day", "event_type")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    rows = rollups.snapshot_scores(rollups.merged(spark, folder, "day", "event_type"), "day", "event_type")
    return rows.select(F.col("day").cast("string").alias("day"), "n", "n_tokens", F.round("bits", 8).alias("bits"))


# -------------------------------------------------------------------- training windows

#: January 2024 in microseconds since 1970, the span of the events.
_JANUARY = (1704067200000000, 1706745600000000)
_FRAMES = "SELECT w.*, f.frame, f.n, f.total FROM w LEFT JOIN (SELECT w.win, (e.at - w.begin) // {stride} AS frame, count(*) AS n, sum(e.value) AS total FROM w JOIN (SELECT epoch_us(ts) AS at, value FROM events) e ON e.at >= w.begin AND e.at < w.begin + {size} GROUP BY 1, 2) f ON f.win = w.win"
_SUMMED = 'SELECT win AS "window", worker, begin, CAST(count(n) AS INT) AS n_frames, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(n * frame), 0) AS BIGINT) AS moment, round(coalesce(sum(total), 0), 4) AS total FROM s GROUP BY 1, 2, 3'


def _summed(rows):
    def over(field):
        return F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + field(f))

    total = F.aggregate("frames", F.lit(0.0), lambda a, f: a + F.coalesce(f["total"], F.lit(0.0)))
    return rows.select(
        "window", "worker", "begin", F.size("frames").alias("n_frames"), over(lambda f: f["n"]).alias("n"), over(lambda f: f["n"] * f["frame"]).alias("moment"), F.round(total, 4).alias("total")
    )


def _sampled(spark, d, plan):
    return _summed(curriculum.samples(table(spark, d, "events"), plan, F.unix_micros(F.col("ts").cast("timestamp")), F.col("value")))


_SWEEP = curriculum.Plan(curriculum.phase_of(7), 7, *_JANUARY, length=12, hop=6, workers=4)
# The schedule's 5,000 bursts are for a span of millennia; a month gets 40.
_BURSTS = curriculum.Plan(replace(curriculum.phase_of(20), bursts=40), 20, *_JANUARY, length=3600, hop=3600, workers=4, seed=1)


@query(f"""WITH w AS (SELECT i AS win, i % 4 AS worker, {_JANUARY[0]} + i * 43200000000 AS begin FROM range(0, 61) r(i)), s AS ({_FRAMES.format(stride=7200000000, size=86400000000)}) {_SUMMED}""")
def curriculum_sweep(spark, d):
    """Epoch 7: windows of twelve frames of two hours over all events."""
    return _sampled(spark, d, _SWEEP)


@query(f"""WITH b AS (SELECT i AS burst, {_JANUARY[0]} + CAST(floor(('0x' || substr(md5('1:20:' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * ({_JANUARY[1] - _JANUARY[0]} - 604800000000)) AS BIGINT) AS anchor FROM range(0, 40) r(i)),
w AS (SELECT burst * 7 + j AS win, burst % 4 AS worker, anchor + j * 86400000000 AS begin FROM b, range(0, 7) q(j)), s AS ({_FRAMES.format(stride=24000000, size=86400000000)}) {_SUMMED}""")
def curriculum_bursts(spark, d):
    """Epoch 20: weeks at drawn places, cut into windows of 3600 frames of 24 seconds."""
    return _sampled(spark, d, _BURSTS)


# --------------------------------------------------------------------------- SQL names


@query("""SELECT o_orderkey, round(588465.5::DOUBLE + o_orderkey * (24::DOUBLE / 86400), 6) AS jd, CAST(o_orderkey % 64 * 64 + o_custkey % 64 AS INT) AS leaf, round(o_totalprice + 180 - 360 * floor((o_totalprice + 180) / 360) - 180, 6) AS wrapped,
CAST(floor((o_totalprice - 360 * floor(o_totalprice / 360)) / 30) AS INT) AS sign FROM orders""")
def sql_functions(spark, d):
    registry.register(spark)
    table(spark, d, "orders").createOrReplaceTempView("skyloom_orders")
    return spark.sql(
        "SELECT o_orderkey, round(frame_to_jd(o_orderkey), 6) AS jd, leaf_of(CAST(o_orderkey % 64 AS INT), CAST(o_custkey % 64 AS INT)) AS leaf, round(wrap180(o_totalprice), 6) AS wrapped, sign_of(o_totalprice) AS sign FROM skyloom_orders"
    )


@query("SELECT i AS frame, round(588465.5::DOUBLE + i * (24::DOUBLE / 86400), 6) AS jd FROM range(100, 140) r(i)")
def sql_frames(spark, d):
    registry.register(spark)
    return spark.sql("SELECT frame, round(jd, 6) AS jd FROM gen_frames(100, 140)")


# ------------------------------------------------------------------- graphs and vectors

def _unit(p: str) -> str:
    return f"[{p}[1] / sqrt(list_dot_product({p}, {p})), {p}[2] / sqrt(list_dot_product({p}, {p})), {p}[3] / sqrt(list_dot_product({p}, {p}))]"


def _between(p: str, q: str) -> str:
    return f"[{p}[1] + {q}[1], {p}[2] + {q}[2], {p}[3] + {q}[3]]"


def _normal(p: str, q: str) -> str:
    return f"[{p}[2] * {q}[3] - {p}[3] * {q}[2], {p}[3] * {q}[1] - {p}[1] * {q}[3], {p}[1] * {q}[2] - {p}[2] * {q}[1]]"


# All triangles from the solid's corners by halved edges; a place is in the one whose three sides it is on the inner side of.
_TRIANGLES = f"""g AS (SELECT (1 + sqrt(5)) / 2 AS u), v AS (SELECT {_unit("p")} AS p FROM (SELECT unnest([[0.0::DOUBLE, a, b * u], [a, b * u, 0.0], [b * u, 0.0, a]]) AS p FROM g, (VALUES (-1), (1)) x(a), (VALUES (-1), (1)) y(b))),
e AS (SELECT x.p, y.p AS q FROM v x JOIN v y ON x.p < y.p AND list_dot_product(x.p, y.p) > 0.4),
t(k, parent, a, b, c) AS (SELECT 0, [0.0::DOUBLE], x.p, x.q, y.q FROM e x JOIN e y ON y.p = x.q JOIN e z ON z.p = x.p AND z.q = y.q
UNION ALL SELECT k + 1, [a[1] + b[1] + c[1], a[2] + b[2] + c[2], a[3] + b[3] + c[3]], s.x, s.y, s.z FROM (SELECT k, a, b, c, {_unit("ab")} AS ab, {_unit("bc")} AS bc, {_unit("ca")} AS ca FROM (SELECT k, a, b, c, {_between("a", "b")} AS ab, {_between("b", "c")} AS bc, {_between("c", "a")} AS ca FROM t WHERE k < 3)),
unnest([{{'x': a, 'y': ab, 'z': ca}}, {{'x': ab, 'y': b, 'z': bc}}, {{'x': ca, 'y': bc, 'z': c}}, {{'x': ab, 'y': bc, 'z': ca}}]) r(s)),
w AS (SELECT row_number() OVER () AS id, dense_rank() OVER (ORDER BY parent) AS parent, a, b, c, {_normal("a", "b")} AS na, {_normal("b", "c")} AS nb, {_normal("c", "a")} AS nc, [a[i] + b[i] + c[i] FOR i IN [1, 2, 3]] AS m FROM t WHERE k = 3)"""


@query(f"""WITH RECURSIVE {_TRIANGLES}, u AS (SELECT user_id, radians(user_id % 100 - 50 + 0.37::DOUBLE) AS lat, radians(user_id % 300 - 150 + 0.21::DOUBLE) AS lng, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2, 3),
p AS (SELECT n, total, [cos(lat) * cos(lng), cos(lat) * sin(lng), sin(lat)] AS p FROM u),
h AS (SELECT w.id, sum(n) AS n, sum(total) AS total FROM p JOIN w ON list_dot_product(na, p) * list_dot_product(na, c) > 0 AND list_dot_product(nb, p) * list_dot_product(nb, a) > 0 AND list_dot_product(nc, p) * list_dot_product(nc, b) > 0 GROUP BY w.id),
k AS (SELECT id, unnest([a, b, c]) AS q FROM w), l AS (SELECT id, [CAST(round(q[i] * 1e9) AS BIGINT) FOR i IN [1, 2, 3]] AS q FROM k), s AS (SELECT x.id AS src, y.id AS dst FROM l x JOIN l y ON x.q = y.q AND x.id <> y.id GROUP BY 1, 2 HAVING count(*) = 2),
d AS (SELECT s.src AS id, sum(h.n) AS n FROM s JOIN h ON h.id = s.dst GROUP BY 1), f AS (SELECT w.parent, sum(n) AS n FROM h JOIN w ON w.id = h.id GROUP BY 1)
SELECT round(m[1], 6) + 0.0 AS x, round(m[2], 6) + 0.0 AS y, round(m[3], 6) + 0.0 AS z, CAST(h.n AS BIGINT) AS n, round(h.total, 4) AS total, CAST(coalesce(d.n, 0) AS BIGINT) AS n_beside, CAST(f.n AS BIGINT) AS n_parent FROM h JOIN w ON w.id = h.id LEFT JOIN d ON d.id = h.id JOIN f ON f.parent = w.parent""")
def triangle_events(spark, d):
    """The events by triangle of three halvings, those in the triangles beside it, and those in its parent."""
    places = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    at = triangles.triangle_of(F.col("user_id") % 100 - 50 + F.lit(0.37), F.col("user_id") % 300 - 150 + F.lit(0.21), 3)
    here = places.select(at.alias("triangle"), "n", "total").groupBy("triangle").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    beside = here.select(F.explode(triangles.triangle_neighbours(F.col("triangle"), 3)).alias("triangle"), F.col("n").alias("m")).groupBy("triangle").agg(F.sum("m").alias("n_beside"))
    parents = here.groupBy(F.shiftright("triangle", 2).alias("parent")).agg(F.sum("n").alias("n_parent"))
    rows = here.join(beside, "triangle", "left").withColumn("parent", F.shiftright("triangle", 2)).join(parents, "parent")
    rows = rows.withColumn("c", triangles.triangle_corners(F.col("triangle"), 3))
    centre = [(F.round(F.col("c.a")[i] + F.col("c.b")[i] + F.col("c.c")[i], 6) + F.lit(0.0)).alias(name) for i, name in enumerate("xyz")]
    return rows.select(*centre, "n", F.round("total", 4).alias("total"), F.coalesce("n_beside", F.lit(0)).alias("n_beside"), "n_parent")


# The last vectors' codes move with the order of sums, so the result is rounded; SQL has no such loop.
@query()
def codebook_training(spark, d):
    """Every vector with its codes in a two-level book that is trained on all of them, stopped after a step and started again."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    folder = _folder(spark, "codebook")
    for steps in (1, 4):
        book = codebook.train(rows, folder, k=16, m=8, steps=steps, decay=0.5, seed=1)
    return codebook.coded(rows, book).select(F.col("id").alias("vec_id"), "macro", "micro", F.round("error", 6).alias("error"))



@query(f"""{_UNIT.replace("WITH u", "WITH RECURSIVE u")}, e AS (SELECT src, dst FROM (SELECT src, dst, la, lb, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS k FROM c WHERE src <> dst) WHERE k <= 6 AND la = lb),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, root) AS (SELECT id, id FROM u UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id),
g AS (SELECT u.label AS token, root, count(*) AS n FROM m JOIN u ON u.id = m.id GROUP BY 1, 2) SELECT token, count(*) AS n_components, round(max(n) / sum(n)::DOUBLE, 9) AS largest_fraction FROM g GROUP BY token""")
def components(spark, d):
    v = _vectors(spark, d)
    edges = relation.k_nearest(v, v, 6, drop_self=True)
    nodes = v.select(F.col("id").alias("node"), F.col("label").alias("token"))
    found = kernels.graph_components(nodes, edges, _folder(spark, "components"))
    return found.withColumn("largest_fraction", F.round("largest_fraction", 9))


@query("""WITH RECURSIVE l AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS frame, user_id % 24 AS node, max(ascii(event_type) % 4) AS token FROM events GROUP BY 1, 2),
b AS (SELECT x.frame, x.node AS src, y.node AS dst FROM l x JOIN l y ON y.frame = x.frame AND y.token = x.token AND (y.node = (x.node + 1) % 24 OR x.node = (y.node + 1) % 24)),
r(frame, id, root) AS (SELECT frame, node, node FROM l UNION SELECT b.frame, b.dst, r.root FROM r JOIN b ON b.frame = r.frame AND b.src = r.id), m AS (SELECT frame, id, min(root) AS root FROM r GROUP BY 1, 2),
g AS (SELECT l.frame, l.token, root, count(*) AS n FROM m JOIN l ON l.frame = m.frame AND l.node = m.id GROUP BY 1, 2, 3), f AS (SELECT frame, token, count(*) AS n_components, max(n) / sum(n)::DOUBLE AS largest FROM g GROUP BY 1, 2)
SELECT CAST(token AS BIGINT) AS token, round(avg(n_components), 6) AS mean_components, round(1 - avg(largest), 6) AS dispersion FROM f GROUP BY token""")
def mesh_dispersion(spark, d):
    days = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    rows = table(spark, d, "events").groupBy(days.alias("frame"), (F.col("user_id") % 24).alias("node")).agg(F.max(F.ascii("event_type") % 4).alias("token"))
    ring = spark.createDataFrame([(i, (i + 1) % 24) for i in range(24)], "src long, dst long")
    found = kernels.dispersion(kernels.token_components(rows, ring))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_components", "dispersion")})


_COV = {(i, j): f"covar_pop({a}, {b})" for i, a in enumerate("qdty") for j, b in enumerate("qdty")}
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"


def _replaced(k: int) -> str:
    """The determinant of the penalised matrix with column k replaced by the target's covariances."""
    return _DET.format(*[f"c{i}3" if j == k else f"(c{i}{j} + lam)" if i == j else f"c{i}{j}" for i in range(3) for j in range(3)])


@query(f"""WITH x AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice AS y FROM lineitem), c AS (SELECT {", ".join(f"{f} AS c{i}{j}" for (i, j), f in _COV.items())} FROM x),
p AS (SELECT *, 1e-3 * ((c00 + c11 + c22) / 3 + 1e-9) AS lam FROM c), b AS (SELECT abs({_replaced(0)} / {_replaced(9)}) AS quantity, abs({_replaced(1)} / {_replaced(9)}) AS discount, abs({_replaced(2)} / {_replaced(9)}) AS tax FROM p)
SELECT unnest(['quantity', 'discount', 'tax']) AS feature, round(unnest([quantity, discount, tax]) / (quantity + discount + tax), 6) AS share FROM b""")
def ridge_attr(spark, d):
    items = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    row = statistics.moments(items, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").first()
    shares = statistics.attribution(statistics.ridge(row, 3), ["quantity", "discount", "tax"])
    return spark.createDataFrame(sorted((k, round(v, 6)) for k, v in shares.items()), "feature string, share double")


@query("SELECT p_partkey, round(p_retailprice / 1000, 6) AS micro, round(p_size / 64.0::DOUBLE, 6) AS fast, round((p_partkey % 7)::DOUBLE, 6) AS cyclic, round(-p_retailprice / 2000, 6) AS macro FROM part")
def band_spectra(spark, d):
    """Four energies as a spectrum of 96 samples, and back."""
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("micro"), (F.col("p_size") / 64).alias("fast"), (F.col("p_partkey") % 7).cast("double").alias("cyclic"), (-F.col("p_retailprice") / 2000).alias("macro"))
    spectrum = rows.select("p_partkey", transducer.emit({b: F.col(b) for b in transducer.BANDS}).alias("s"))
    return spectrum.select("p_partkey", *[F.round(c, 6).alias(b) for b, c in transducer.recover(F.col("s")).items()])


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings")
def sphere_round_trip(spark, d):
    """Latents as relief on the sphere's grid, and back."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("latent"))
    back = transducer.analyze(transducer.synthesize(rows)).select("vec_id", F.posexplode("latent").alias("i", "x"))
    return back.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
