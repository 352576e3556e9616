"""Registered queries over the driver's tables, each with the SQL that must agree with it.

Stand-ins: a user is a node, an event type a token, a value a potential, an account
balance or price an angle. Transcendental results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import aspects, calendar, cells, light, tokens, zodiac
from skyloom.functions.angles import dot, great_circle_deg, norm, separation_deg
from skyloom.operators import along, density, kernels, rarity, relation, rollup, sequence, statistics, twin, viewport
from skyloom.sinks.store import pending
from skyloom.sources import mesh as meshes
from skyloom.sources.positions import sidereal
from skyloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ viewport and tiers


@query("""SELECT event_id, ts, user_id, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' AND user_id IN (1,2,3,5,8,13,21,34,55,89) AND value >= 50
ORDER BY value DESC, event_id LIMIT 1000""")
def viewport_topk(spark, d):
    where = F.col("ts").between(F.expr("timestamp_ntz'2024-01-05 00:00:00'"), F.expr("timestamp_ntz'2024-01-25 00:00:00'"))
    where &= F.col("user_id").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89) & (F.col("value") >= 50)
    return viewport.top_rows(table(spark, d, "events").select("event_id", "ts", "user_id", "value"), where, F.desc("value"), "event_id", limit=1000)


@query("""SELECT user_id, date_trunc('hour', ts) AS hour, max(value) AS max_value, count(*) AS n,
  (SELECT 1) AS one FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id, date_trunc('hour', ts) HAVING max(value) >= 100 ORDER BY max_value DESC, user_id, hour LIMIT 1000""")
def viewport_hourly(spark, d):
    rows = table(spark, d, "events").where(F.col("ts") >= F.expr("timestamp_ntz'2024-01-10 00:00:00'"))
    hours = rows.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max("value").alias("max_value"), F.count("*").alias("n"))
    return hours.where(F.col("max_value") >= 100).withColumn("one", F.lit(1)).orderBy(F.desc("max_value"), "user_id", "hour").limit(1000)


@query("""SELECT span, velocity, CASE WHEN f <= 1000 THEN 'tier1' WHEN f <= 150000 THEN 'tier2' ELSE 'tier3' END AS tier FROM
(SELECT span, velocity, floor(greatest(1, floor(span * 3600)) / greatest(velocity, 1)) AS f FROM
 (SELECT o_totalprice / 1000.0 AS span, CAST(o_orderkey % 7 AS DOUBLE) AS velocity FROM orders))""")
def tier_router(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_totalprice") / 1000.0).alias("span"), (F.col("o_orderkey") % 7).cast("double").alias("velocity"))
    return rows.withColumn("tier", viewport.tier_column(F.col("span"), F.col("velocity")))


# ------------------------------------------------------------------------ rarity


@query("SELECT event_type, count(*) AS n, count(*) / (SELECT count(*) FROM events)::DOUBLE AS p FROM events GROUP BY event_type")
def token_pmf(spark, d):
    return rarity.pmf(rarity.histogram(table(spark, d, "events"), "event_type"))


@query("""WITH h AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), t AS (SELECT sum(n)::DOUBLE AS total FROM h)
SELECT l_suppkey, n, round(least(greatest(-ln(n / total) / ln(greatest(total, 4096)), 0), 1), 9) AS rarity FROM h, t""")
def rarity_index(spark, d):
    return rarity.rarity_table(rarity.histogram(table(spark, d, "lineitem"), "l_suppkey")).withColumn("rarity", F.round("rarity", 9))


@query("""WITH h AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey), t AS (SELECT sum(n)::DOUBLE AS total FROM h)
SELECT o.l_orderkey, o.l_linenumber, round(least(greatest(-ln(CASE WHEN n > 0 THEN n / total ELSE 1.0 / (total + 4096) END) / ln(greatest(total, 4096)), 0), 1), 9) AS rarity
FROM lineitem o LEFT JOIN h ON h.l_suppkey = o.l_suppkey, t""")
def rarity_of_rows(spark, d):
    items = table(spark, d, "lineitem")
    hist = rarity.histogram(items.where("l_returnflag = 'R'"), "l_suppkey")
    return rarity.score_rows(items.select("l_orderkey", "l_linenumber", "l_suppkey"), hist, "l_suppkey").select("l_orderkey", "l_linenumber", F.round("rarity", 9).alias("rarity"))


@query("""WITH h AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), t AS (SELECT sum(n)::DOUBLE AS total FROM h),
r AS (SELECT round(least(greatest(-ln(n / total) / ln(greatest(total, 4096)), 0), 1), 9) AS rarity, n, total FROM h, t),
c AS (SELECT rarity, total, sum(n) OVER (ORDER BY rarity RANGE UNBOUNDED PRECEDING) AS c FROM r)
SELECT min(rarity) AS threshold FROM c WHERE c >= 0.9 * total""")
def weighted_rarity_threshold(spark, d):
    scored = rarity.rarity_table(rarity.histogram(table(spark, d, "lineitem"), "l_suppkey")).withColumn("rarity", F.round("rarity", 9))
    return rarity.weighted_percentile(scored, 0.9)


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.9999), 6) AS p9999 FROM events")
def value_percentiles(spark, d):
    found = statistics.quantiles(table(spark, d, "events"), {"value": (F.col("value"), [0.5, 0.99, 0.9999])})["value"]
    return spark.createDataFrame([tuple(found)], "p50 double, p99 double, p9999 double").select(*[F.round(c, 6).alias(c) for c in ("p50", "p99", "p9999")])


@query("SELECT round(exp(-sum(p * ln(p + 1e-10))), 6) AS perplexity FROM (SELECT count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS p FROM lineitem GROUP BY l_suppkey)")
def token_perplexity(spark, d):
    return rarity.perplexity(rarity.histogram(table(spark, d, "lineitem"), "l_suppkey")).withColumn("perplexity", F.round("perplexity", 6))


# ---------------------------------------------------------------------- roll-ups

_EVENTS_AS_ROWS = "SELECT user_id, ts, value AS potential, value / 2 AS shear, event_type AS leaf, value / 400 AS rarity FROM events"
_LOWEST_MODE = """SELECT user_id, b, leaf AS archetype FROM (SELECT user_id, b, leaf, row_number() OVER (PARTITION BY user_id, b ORDER BY count(*) DESC, leaf) AS k
 FROM (SELECT *, date_trunc('{unit}', ts) AS b FROM e) GROUP BY user_id, b, leaf) WHERE k = 1"""


def _event_rows(spark, d, unit):
    rows = table(spark, d, "events")
    return rows.select(
        "user_id", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket"), F.col("ts").alias("jd"), F.col("value").alias("potential"), (F.col("value") / 2).alias("shear"),
        F.col("event_type").alias("leaf"), (F.col("value") / 400).alias("rarity"),
    )


@query(f"""WITH e AS ({_EVENTS_AS_ROWS}), m AS ({_LOWEST_MODE.format(unit="hour")}),
g AS (SELECT user_id, date_trunc('hour', ts) AS bucket, min(ts) AS jd, max(potential) AS max_potential, max(shear) AS peak_shear, max(rarity) AS rarity FROM e GROUP BY 1, 2)
SELECT g.*, archetype FROM g JOIN m ON m.user_id = g.user_id AND m.b = g.bucket""")
def hourly_rollup(spark, d):
    return rollup.hourly(_event_rows(spark, d, "hour"), ["user_id", "bucket"])


@query(f"""WITH e AS ({_EVENTS_AS_ROWS}), m AS ({_LOWEST_MODE.format(unit="day")}),
g AS (SELECT user_id, date_trunc('day', ts) AS bucket, min(ts) AS jd, max(potential) AS max_potential, round(avg(potential), 6) AS mean_potential,
 round(stddev_pop(potential), 6) AS std_potential, max(shear) AS peak_shear, max(rarity) AS rarity, round(avg(rarity), 9) AS mean_rarity, count(*) FILTER (rarity >= 0.9) AS anomaly_count FROM e GROUP BY 1, 2)
SELECT g.*, archetype FROM g JOIN m ON m.user_id = g.user_id AND m.b = g.bucket""")
def daily_rollup(spark, d):
    rows = rollup.daily(_event_rows(spark, d, "day"), ["user_id", "bucket"])
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_potential", "std_potential")}).withColumn("mean_rarity", F.round("mean_rarity", 9))


@query("""SELECT user_id, bucket, max(value) AS max_value, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, count(*) AS n FROM
(SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 15 AS bucket FROM events) GROUP BY user_id, bucket""")
def bucket_ragged(spark, d):
    rows = rollup.bucketed(table(spark, d, "events"), 15, ["user_id"], "event_id")
    return rows.groupBy("user_id", "bucket").agg(F.max("value").alias("max_value"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_pop("value"), 6).alias("std_value"), F.count("*").alias("n"))


# --------------------------------------------------------------------- sequences


def _by_day(spark, d):
    """The events with their day, which cuts each user's axis into blocks."""
    return table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))


_RUNS = """WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, event_type, count(*) AS run_len FROM a GROUP BY user_id, event_type, g)"""


@query(f"{_RUNS} SELECT event_type, round(avg(run_len), 9) AS mean_run, count(*) AS n_runs, max(run_len) AS max_run, round(avg(run_len) * ln(2), 9) AS half_life FROM r GROUP BY event_type")
def persistence_rle(spark, d):
    found = along.runs(_by_day(spark, d), "user_id", "day", ["ts", "event_id"], "event_type")
    return sequence.persistence(found, "event_type").withColumns({c: F.round(c, 9) for c in ("mean_run", "half_life")})


@query("""WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type FROM events),
c AS (SELECT prev, event_type, count(*) AS n FROM p WHERE prev IS NOT NULL AND prev <> event_type GROUP BY prev, event_type)
SELECT prev, event_type, n, round(n / sum(n) OVER (PARTITION BY prev)::DOUBLE, 9) AS probability FROM c""")
def markov_transitions(spark, d):
    return along.transitions(_by_day(spark, d), "user_id", "day", ["ts", "event_id"], "event_type").withColumn("probability", F.round("probability", 9))


@query("""WITH p AS (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, role FROM conversations), c AS (SELECT prev, role, count(*) AS n FROM p WHERE prev IS NOT NULL AND prev <> role GROUP BY prev, role),
k AS (SELECT prev, role, n, round(n / sum(n) OVER (PARTITION BY prev)::DOUBLE, 9) AS probability, row_number() OVER (PARTITION BY prev ORDER BY n DESC, role) AS rank FROM c) SELECT * FROM k WHERE rank <= 2""")
def role_transitions(spark, d):
    moves = sequence.transitions(table(spark, d, "conversations"), "conv_id", ["turn"], "role").withColumn("probability", F.round("probability", 9))
    return sequence.top_per_group(moves, "prev", 2, F.desc("n"), "role")


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), w AS (SELECT *, lag(value) OVER u AS l, lead(value) OVER u AS n, lag(i) OVER u AS li, lead(i) OVER u AS ni FROM o WINDOW u AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, round((coalesce(n, value) - coalesce(l, value)) / nullif(coalesce(ni, i) - coalesce(li, i), 0), 6) AS shear FROM w""")
def temporal_shear(spark, d):
    rows = along.with_halo(_by_day(spark, d), "user_id", "day", ["ts", "event_id"])
    day = Window.partitionBy("user_id", "day")
    rows = rows.withColumn("i", F.row_number().over(day.orderBy("ts", "event_id")))
    return rows.withColumn("shear", F.round(sequence.gradient(F.col("value"), F.col("i"), day.orderBy("i")), 6)).where("_own").select("event_id", "shear")


@query("SELECT event_id, round(value - coalesce(lag(value) OVER w, 0), 6) AS step, round(value, 6) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def delta_roundtrip(spark, d):
    order = ["ts", "event_id"]
    rows = along.with_halo(_by_day(spark, d), "user_id", "day", order)
    steps = rows.withColumn("step", sequence.delta(F.col("value"), Window.partitionBy("user_id", "day").orderBy(*order))).where("_own")
    return along.running_sum(steps, "user_id", "day", order, "step", "back").select("event_id", F.round("step", 6).alias("step"), F.round("back", 6).alias("back"))


@query("SELECT event_id, round(lead(value) OVER w - 2 * value + lag(value) OVER w, 6) AS bend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def second_difference(spark, d):
    rows = along.with_halo(_by_day(spark, d), "user_id", "day", ["ts", "event_id"])
    bend = sequence.second_difference(F.col("value"), Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return rows.withColumn("bend", F.round(bend, 6)).where("_own").select("event_id", "bend")


@query("SELECT user_id, CAST(day AS VARCHAR) AS day, event_id, value FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_per_day(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return sequence.first_per(rows, ["user_id", "day"], "ts", "event_id").select("user_id", F.col("day").cast("string").alias("day"), "event_id", "value")


@query("""WITH i AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), n AS (SELECT user_id, max(i) AS last FROM i GROUP BY user_id),
w AS (SELECT user_id, unnest(range(0, last // 8 + 1)) AS win, last FROM n)
SELECT w.user_id, win AS "window", round(sum(value), 6) AS total FROM w JOIN i ON i.user_id = w.user_id AND i BETWEEN win * 8 AND win * 8 + 15 WHERE win * 8 + 15 <= last GROUP BY 1, 2""")
def sliding_windows(spark, d):
    rows = along.position(_by_day(spark, d), "user_id", "day", ["ts", "event_id"], "i")
    return sequence.sliding(rows, "i", 16, 8, ["user_id"]).groupBy("user_id", "window").agg(F.round(F.sum("value"), 6).alias("total"))


# -------------------------------------------------------------------- statistics

_DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS volume FROM events GROUP BY 1, 2"
_GRID = f"""WITH v AS ({_DAILY}), g AS (SELECT day, event_type FROM (SELECT DISTINCT day FROM v), (SELECT DISTINCT event_type FROM v)),
m AS (SELECT g.day, g.event_type, coalesce(volume, 0) AS volume FROM g LEFT JOIN v USING (day, event_type))"""


def _daily(spark, d):
    v = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("volume"))
    return v, statistics.completed(v, v.select("day").distinct(), v.select("event_type").distinct(), "volume")


@query(f"{_GRID} SELECT CAST(day AS VARCHAR) AS day, event_type, volume FROM m")
def day_token_matrix(spark, d):
    return _daily(spark, d)[1].withColumn("day", F.col("day").cast("string"))


@query(f"""{_GRID}, s AS (SELECT event_type FROM m GROUP BY event_type HAVING stddev_pop(volume) > 1e-9)
SELECT x.event_type AS a, y.event_type AS b, round(covar_pop(x.volume, y.volume) / (stddev_pop(x.volume) * stddev_pop(y.volume)), 6) AS corr
FROM m x JOIN m y ON x.day = y.day AND x.event_type < y.event_type WHERE x.event_type IN (SELECT event_type FROM s) AND y.event_type IN (SELECT event_type FROM s) GROUP BY 1, 2""")
def exclusion_corr(spark, d):
    return statistics.correlations(_daily(spark, d)[1], "day", "event_type", "volume").withColumn("corr", F.round("corr", 6))


@query("""WITH b AS (SELECT o_orderpriority, (year(o_orderdate) * 12 + month(o_orderdate) - 1) // 5 AS bin, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT p.o_orderpriority, bin FROM (SELECT DISTINCT o_orderpriority FROM b) p, (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM b)),
m AS (SELECT o_orderpriority, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (o_orderpriority, bin))
SELECT o_orderpriority, round(CASE WHEN avg(n) = 0 THEN 0 ELSE var_pop(n) / avg(n) END, 6) AS fano FROM m GROUP BY o_orderpriority""")
def fano_factor(spark, d):
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    b = table(spark, d, "orders").groupBy("o_orderpriority", F.floor(month / 5).alias("bin")).agg(F.count("*").alias("n"))
    bins = b.agg(F.min("bin").alias("x"), F.max("bin").alias("y")).select(F.explode(F.sequence("x", "y")).alias("bin"))
    dense = statistics.completed(b, b.select("o_orderpriority").distinct(), bins, "n")
    return statistics.fano(dense, "o_orderpriority", "n").withColumn("fano", F.round("fano", 6))


@query(f"""WITH v AS (SELECT date_diff('day', DATE '2024-01-01', day) AS t, event_type, volume FROM ({_DAILY})), lim AS (SELECT min(t) AS a, max(t) - min(t) + 1 AS n FROM v),
d AS (SELECT e.event_type, k.t - a AS t, coalesce(volume, 0)::DOUBLE AS x, n FROM (SELECT DISTINCT event_type FROM v) e, (SELECT unnest(range(a, a + n)) AS t FROM lim) k, lim, (SELECT 1) LEFT JOIN v ON v.event_type = e.event_type AND v.t = k.t),
c AS (SELECT event_type, t, n, x - avg(x) OVER (PARTITION BY event_type) AS x FROM d), f AS (SELECT unnest(range(1, n // 2 + 1)) AS k FROM lim),
p AS (SELECT event_type, k, max(n) AS n, pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2) AS power FROM c, f GROUP BY event_type, k)
SELECT event_type, round(max(n)::DOUBLE / arg_max(k, power), 6) AS period_days, round(max(power) / (sum(power) + 1e-12), 6) AS power_fraction FROM p WHERE (SELECT n FROM lim) >= 16 GROUP BY event_type""")
def dominant_period(spark, d):
    daily = _daily(spark, d)[0].withColumn("t", F.datediff("day", F.lit("2024-01-01").cast("date")))
    found = statistics.dominant_period(daily, "event_type", "t", "volume")
    return found.withColumns({c: F.round(c, 6) for c in ("period_days", "power_fraction")})




@query("""WITH a AS (SELECT median(l_extendedprice) AS m FROM lineitem), b AS (SELECT median(abs(l_extendedprice - m)) AS mad FROM lineitem, a)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, a, b WHERE l_extendedprice > m + 1 * 1.4826 * mad""")
def robust_outliers(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return items.crossJoin(F.broadcast(statistics.robust_threshold(items, "l_extendedprice", 1.0))).where("l_extendedprice > threshold").drop("threshold")


@query("""WITH a AS (SELECT median(l_extendedprice) AS mp, median(l_quantity) AS mq, avg(l_extendedprice) AS ap, stddev_pop(l_extendedprice) AS sp, avg(l_quantity) AS aq, stddev_pop(l_quantity) AS sq FROM lineitem),
b AS (SELECT median(abs(l_extendedprice - mp)) AS dp, median(abs(l_quantity - mq)) AS dq FROM lineitem, a)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - ap) / sp + (l_quantity - aq) / sq, 6) AS score FROM lineitem, a, b
WHERE l_extendedprice > mp + 1 * 1.4826 * dp AND l_quantity > mq + 1 * 1.4826 * dq ORDER BY (l_extendedprice - ap) / sp + (l_quantity - aq) / sq DESC, l_orderkey, l_linenumber LIMIT 200""")
def singularities(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    found = statistics.singularities(items, "l_extendedprice", "l_quantity", 1.0, 200, ("l_orderkey", "l_linenumber"))
    return found.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@query("""SELECT event_type, round(sqrt(pow(sum(value * cos(a)), 2) + pow(sum(value * sin(a)), 2)) / sum(value), 6) AS concentration,
round(CASE WHEN atan2(sum(value * sin(a)), sum(value * cos(a))) < 0 THEN atan2(sum(value * sin(a)), sum(value * cos(a))) + 2 * pi() ELSE atan2(sum(value * sin(a)), sum(value * cos(a))) END, 6) AS mean_angle
FROM (SELECT event_type, value, (hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440 AS a FROM events) GROUP BY event_type""")
def circular_mean(spark, d):
    angle = (F.hour("ts") * 60 + F.minute("ts")) * 2 * F.pi() / 1440
    found = statistics.circular_mean(table(spark, d, "events"), ["event_type"], angle, F.col("value"))
    return found.withColumns({c: F.round(c, 6) for c in ("concentration", "mean_angle")})


@query("""WITH u AS (SELECT 'discount' AS feature, l_discount AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'quantity', l_quantity, l_extendedprice FROM lineitem UNION ALL SELECT 'tax', l_tax, l_extendedprice FROM lineitem)
SELECT feature, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS corr FROM u GROUP BY feature HAVING stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9""")
def feature_correlations(spark, d):
    items = table(spark, d, "lineitem").select(*[F.col(f"l_{c}").alias(c) for c in ("discount", "quantity", "tax")], F.col("l_extendedprice").alias("y"))
    return statistics.column_correlations(items, ["discount", "quantity", "tax"], "y").withColumn("corr", F.round("corr", 6))


# -------------------------------------------------------------------- aspects

_ANGLE = "s_acctbal - 360 * floor(s_acctbal / 360)"


@query(f"""WITH s AS (SELECT s_suppkey AS id, {_ANGLE} AS a, s_nationkey AS g FROM supplier),
p AS (SELECT x.g, x.id AS a, y.id AS b, least(abs(x.a - y.a), 360 - abs(x.a - y.a)) AS sep FROM s x JOIN s y ON x.g = y.g AND x.id < y.id)
SELECT g, round(sum(exp(-0.5 * pow(sep / 6, 2)) + exp(-0.5 * pow((sep - 60) / 6, 2)) + exp(-0.5 * pow((sep - 120) / 6, 2))), 6) AS resonance,
round(sum(exp(-0.5 * pow((sep - 90) / 6, 2)) + exp(-0.5 * pow((sep - 180) / 6, 2))), 6) AS tension FROM p GROUP BY g""")
def pair_kernels(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), zodiac.circle(F.col("s_acctbal")).alias("angle"), F.col("s_nationkey").alias("g"))
    b = s.select(F.col("id").alias("b"), F.col("angle").alias("angle_b"), "g")
    pairs = s.join(b, "g").where("id < b").withColumn("sep", separation_deg(F.col("angle"), F.col("angle_b")))
    return pairs.groupBy("g").agg(F.round(F.sum(aspects.constructive(F.col("sep"))), 6).alias("resonance"), F.round(F.sum(aspects.destructive(F.col("sep"))), 6).alias("tension"))


@query("""SELECT p_partkey, round(1 / (1 + exp(-1.5 * (log10(29.5 * 3600) - log10(greatest(p_retailprice, 1)) + 1))), 9) AS fast_gain,
round(95 + least(greatest(ln(greatest(p_retailprice, 1)) / ln(10256), 0), 1) * 4.99, 6) AS significance FROM part""")
def band_gains(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(aspects.band_gain("fast", p), 9).alias("fast_gain"), F.round(aspects.significance_percentile(p), 6).alias("significance"))


# ------------------------------------------------------------------- twin search

_SIGNED = {"sun": "o_totalprice", "moon": "o_totalprice * 7", "mars": "o_totalprice / 3", "saturn": "o_orderkey * 11.7", "rahu": "o_custkey * 1.3"}
_NATAL_LON = {"sun": 100.0, "moon": 205.0, "mars": 201.0, "saturn": 40.0, "rahu": 310.0}


def _natal() -> dict:
    bodies = {}
    for b, lon in _NATAL_LON.items():
        s = int(lon // 30)
        bodies[b] = {"lon": lon, "sign": s, "deg": lon % 30, "nak": int(lon // (360 / 27)), "nav": (s * 9 + int(lon % 30 // (30 / 9))) % 12, "house": (s - 3) % 12 + 1}
    return twin.key_of(bodies, 3)


def _positions(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", *[zodiac.circle(F.expr(e).cast("double")).alias(f"{b}_lon") for b, e in _SIGNED.items()])
    cols = []
    for b in _SIGNED:
        lon = F.col(f"{b}_lon")
        cols += [lon, zodiac.sign_of(lon).alias(f"{b}_sign"), zodiac.degree_in_sign(lon).alias(f"{b}_deg"), zodiac.nakshatra_of(lon).alias(f"{b}_nak"), zodiac.navamsa_of(lon).alias(f"{b}_nav")]
    return rows.select("o_orderkey", *cols)


def _positions_sql() -> str:
    lon = ", ".join(f"CAST({e} AS DOUBLE) - 360 * floor(CAST({e} AS DOUBLE) / 360) AS {b}_lon" for b, e in _SIGNED.items())
    parts = ", ".join(
        f"{b}_lon, CAST(floor({b}_lon / 30) AS INT) AS {b}_sign, {b}_lon - 30 * floor({b}_lon / 30) AS {b}_deg, CAST(floor({b}_lon / (360.0::DOUBLE / 27)) AS INT) AS {b}_nak,"
        f" (CAST(floor({b}_lon / 30) AS INT) * 9 + CAST(floor(({b}_lon - 30 * floor({b}_lon / 30)) / (30.0::DOUBLE / 9)) AS INT)) % 12 AS {b}_nav"
        for b in _SIGNED
    )
    return f"WITH l AS (SELECT o_orderkey, {lon} FROM orders), p AS (SELECT o_orderkey, {parts} FROM l)"


_TWIN_BODIES = ["sun", "moon", "mars", "saturn", "rahu"]
#: Bodies that are held in each tier's probe, few enough that rows match.
_HELD = {1: ["saturn"], 2: ["sun", "saturn"], 3: ["sun", "mars"], 4: ["moon", "rahu"], 5: ["moon"], 6: ["moon", "mars"], 7: ["sun", "saturn"], 8: ["sun"]}


def _tier_sql(tier: int) -> str:
    b, held = _natal()["bodies"], _HELD[tier]
    sign = [f"{x}_sign = {b[x]['sign']}" for x in held]
    orb = [f"least(abs({x}_lon - {b[x]['lon']}), 360 - abs({x}_lon - {b[x]['lon']})) <= 5" for x in held]
    moon = [f"moon_nak = {b['moon']['nak']}"]
    where = {
        1: sign, 2: sign, 4: sign, 5: sign + moon, 6: sign + moon + ["mars_deg < moon_deg"], 7: orb, 8: [f"{x}_nav = {b[x]['nav']}" for x in held] + orb,
        3: [f"({x}_sign - {b[x]['sign']} + 12) % 12 = ({held[0]}_sign - {b[held[0]]['sign']} + 12) % 12" for x in held[1:]],
    }[tier]
    return " AND ".join(where)


for _tier in twin.TIERS:

    def _run(spark, d, tier=_tier):
        natal = _natal()
        return _positions(spark, d).where(twin.tier_condition(natal, tier, _HELD[tier])).select("o_orderkey", twin.total_matched(natal, tier).alias("matched"))

    _b = _natal()["bodies"]
    _count = (
        " + ".join(f"(least(abs({x}_lon - {_b[x]['lon']}), 360 - abs({x}_lon - {_b[x]['lon']})) <= 5)::INT" for x in _TWIN_BODIES)
        if _tier in (7, 8)
        else "greatest(" + ", ".join("(" + " + ".join(f"(({x}_sign - {_b[x]['sign']} + 12) % 12 = {k})::INT" for x in _TWIN_BODIES) + ")" for k in range(12)) + ")"
        if _tier == 3
        else " + ".join(f"({x}_sign = {_b[x]['sign']})::INT" for x in _TWIN_BODIES)
    )
    QUERIES[f"twin_tier_{_tier}"] = _run
    ORACLES[f"twin_tier_{_tier}"] = f"{_positions_sql()} SELECT o_orderkey, CAST({_count} AS INT) AS matched FROM p WHERE {_tier_sql(_tier)}"


@query(f"{_positions_sql()} SELECT " + ", ".join(f"coalesce(bool_or({_tier_sql(t)}), false) AS tier_{t}" for t in twin.TIERS) + " FROM p")
def twin_available(spark, d):
    natal = _natal()
    return _positions(spark, d).agg(*[F.coalesce(F.bool_or(twin.tier_condition(natal, t, _HELD[t])), F.lit(False)).alias(f"tier_{t}") for t in twin.TIERS])


# ------------------------------------------------------------------------ vectors

_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
_UNIT = f"WITH u AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, sqrt({_DOT.format('embedding', 'embedding')}) AS n FROM embeddings), c AS (SELECT x.id AS src, y.id AS dst, x.label AS la, y.label AS lb, list_dot_product(x.v, y.v) / (x.n * y.n) AS s FROM u x, u y)"


def _vectors(spark, d):
    return relation.normalised(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"))


@query(f"{_UNIT} SELECT src, CAST(slot AS INT) AS slot, dst, round(s, 6) AS score FROM (SELECT src, dst, s, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS slot FROM c) WHERE slot <= 6")
def knn_embeddings(spark, d):
    v = _vectors(spark, d)
    return relation.k_nearest(v, v, 6).withColumn("score", F.round("score", 6))


@query(f"{_UNIT} SELECT src AS node, dst AS antipode FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY s, dst) AS k FROM c) WHERE k = 1")
def antipode(spark, d):
    v = _vectors(spark, d)
    return relation.k_nearest(v, v, 1, largest=False).select(F.col("src").alias("node"), F.col("dst").alias("antipode"))


_CODES = "b AS (SELECT label AS code, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), k AS (SELECT code, list(m ORDER BY i) AS v FROM b GROUP BY code)"


def _codes(spark, d):
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("code")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("vec"))


@query(f"WITH {_CODES} SELECT vec_id AS id, CAST(arg_max(code, list_dot_product(embedding::DOUBLE[], v) / sqrt(list_dot_product(v, v))) AS BIGINT) AS code FROM embeddings, k GROUP BY vec_id")
def nearest_code(spark, d):
    return relation.nearest_code(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), _codes(spark, d))


@query(f"{_UNIT}, m AS (SELECT src AS id, sum(s) FILTER (src <> dst) / (count(*) - 1) AS a FROM c GROUP BY src) SELECT id, round(a, 9) AS mean_cosine, round(100 - 100.0 * row_number() OVER (ORDER BY a, id) / count(*) OVER (), 6) AS percentile FROM m")
def cosine_isolation(spark, d):
    return relation.isolation(_vectors(spark, d)).select("id", F.round("mean_cosine", 9).alias("mean_cosine"), F.round("percentile", 6).alias("percentile"))


@query("SELECT vec_id AS id, round(sqrt(sum(x * x)), 6) AS magnitude, round(var_pop(x), 9) AS dim_variance FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY vec_id")
def dim_variance(spark, d):
    v = relation.dim_variance(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    return v.select("id", F.round("magnitude", 6).alias("magnitude"), F.round("dim_variance", 9).alias("dim_variance"))


@query(f"""{_UNIT}, e AS (SELECT src, dst, la, lb FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS k FROM c WHERE src <> dst) WHERE k <= 6), n AS (SELECT la AS a, lb AS b, count(*) AS n FROM e GROUP BY 1, 2),
p AS (SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a)::DOUBLE, 9) AS probability, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM n WHERE a <> b) SELECT * FROM p WHERE rank <= 3""")
def halo_cooc(spark, d):
    v = _vectors(spark, d)
    edges = relation.k_nearest(v, v, 6, drop_self=True)
    labels = v.select(F.lit(0).alias("frame"), F.col("id").alias("node"), F.col("label").alias("token"))
    return relation.conditional(relation.cooccurrence(labels, edges, ["frame"]), 3).withColumn("probability", F.round("probability", 9))


@query(f"""WITH a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(sqrt({_DOT.format("embedding", "embedding")}), 6) AS norm,
round({_DOT.format("embedding", "v")} / sqrt({_DOT.format("embedding", "embedding")} * list_dot_product(v, v)), 6) AS cosine FROM embeddings, a""")
def resonance_anchor(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return relation.anchored(v, v.where("id = 0")).withColumns({c: F.round(c, 6) for c in ("norm", "cosine")})


@query(f"{_UNIT}, q AS (SELECT dst AS id, s FROM c WHERE src = 7) SELECT id, round(s, 6) AS score FROM q ORDER BY s DESC, id LIMIT 12")
def similar_topk(spark, d):
    v = _vectors(spark, d)
    q = F.broadcast(v.where("id = 7").select(F.col("vec").alias("q")))
    scored = v.crossJoin(q).select("id", dot(F.col("vec"), F.col("q")).alias("s"))
    return scored.orderBy(F.desc("s"), "id").limit(12).select("id", F.round("s", 6).alias("score"))


@query()
def pca_axes(spark, d):
    return kernels.principal_axes(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


@query()
def clusters(spark, d):
    """Density clusters of all vectors; no SQL says this, a brute-force test does."""
    return density.density_clusters(table(spark, d, "embeddings"), "embedding", id="vec_id").select("vec_id", "cluster_id")


# --------------------------------------------------------------------- joins, sets


@query("""SELECT p_partkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM part JOIN orders ON o_totalprice BETWEEN p_retailprice * 20 - 500 AND p_retailprice * 20 + 500 GROUP BY p_partkey""")
def band_lookup(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 20).alias("at"))
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))
    hits = p.join(relation.highest_within(p, o, 500.0), "at")
    return hits.groupBy("p_partkey").agg(F.max_by("id", F.struct("value", -F.col("id"))).alias("o_orderkey"))


@query("""SELECT u.user_id, n, events_value, orders_n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS n, round(sum(value), 4) AS events_value FROM events WHERE event_type = 'purchase' GROUP BY user_id) a USING (user_id)
LEFT JOIN (SELECT o_custkey AS user_id, count(*) AS orders_n FROM orders GROUP BY o_custkey) b USING (user_id)""")
def profile_merge(spark, d):
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("events_value"))
    ordered = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders_n"))
    return relation.spine(e.select("user_id").distinct(), [bought, ordered], "user_id")


@query("SELECT DISTINCT o_orderkey // 16 AS chunk FROM orders WHERE o_orderkey // 16 NOT IN (SELECT l_orderkey // 16 FROM lineitem WHERE l_quantity >= 49)")
def pending_chunks(spark, d):
    """Chunks of sixteen orders that the ledger, those with a line of 49 pieces or more, does not have."""
    chunk = lambda c: F.floor(F.col(c) / 16).alias("chunk")
    return pending(table(spark, d, "orders").select(chunk("o_orderkey")).distinct(), table(spark, d, "lineitem").where("l_quantity >= 49").select(chunk("l_orderkey")))


@query("SELECT n_name, r_name, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0")
def plain_joins(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.where("s_acctbal > 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "s_suppkey", "s_acctbal")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_operations(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("id")).union(table(spark, d, "orders").select("o_custkey"))
    return ids.distinct().subtract(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"))


# ---------------------------------------------------------------- generated tables


@query("""WITH n AS (SELECT i, asin(1 - 2 * (i + 0.5) / 2000) AS lat, (i * (pi() * (3 - sqrt(5.0))) + pi()) AS l FROM range(2000) t(i)), m AS (SELECT i, lat, l - 2 * pi() * floor(l / (2 * pi())) - pi() AS lon FROM n)
SELECT CAST(i AS INT) AS node, round(degrees(lat), 6) AS lat_deg, round(degrees(lon), 6) AS lng_deg, CAST(floor((degrees(lat) + 90) / 4) * 100000 + floor((degrees(lon) + 180) / 4) AS BIGINT) AS cell FROM m""")
def mesh_nodes(spark, d):
    return meshes.fibonacci(spark, 2000).select("node", F.round("lat_deg", 6).alias("lat_deg"), F.round("lng_deg", 6).alias("lng_deg"), "cell")


@query("SELECT CAST(r AS BIGINT) * 100000 + c AS cell FROM range(25, 34) a(r), range(40, 52) b(c)")
def cell_cover(spark, d):
    return spark.createDataFrame([(c,) for c in cells.cover(10.0, -20.0, 45.9, 27.9)], "cell long")


@query("""SELECT o_orderkey, julian(o_orderdate::TIMESTAMP) - 0.5 AS jd, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, CAST(floor(year(o_orderdate) / 100.0) AS INT) AS century FROM orders""")
def julian_days(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))
    jd = calendar.gregorian_to_jd(F.year("t"), F.month("t"), F.dayofmonth("t"), F.hour("t"), F.minute("t"), F.second("t"))
    o = o.withColumn("jd", jd).withColumn("g", calendar.jd_to_gregorian(F.col("jd")))
    return o.select("o_orderkey", "jd", F.col("g.year").alias("year"), F.col("g.month").alias("month"), F.col("g.day").alias("day"), calendar.century_of(F.col("jd")).alias("century"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_suppkey * 64 + l_partkey % 64 AS INT) AS leaf, CAST(l_suppkey AS INT) AS macro, CAST(l_partkey % 64 AS INT) AS micro FROM lineitem""")
def token_packing(spark, d):
    leaf = tokens.leaf_of(F.col("l_suppkey"), F.col("l_partkey") % 64)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", leaf.alias("leaf"))
    return rows.withColumns({"macro": tokens.macro_of(F.col("leaf")), "micro": tokens.micro_of(F.col("leaf"))})


@query("""WITH r AS (SELECT p_partkey, least(greatest(p_retailprice / 2500, 0), 1) AS r FROM part), t AS (SELECT p_partkey, r, 1200 * pow(40000.0 / 1200, r) AS k FROM r)
SELECT p_partkey, round(k, 4) AS kelvin, round(ln(k / 1200) / ln(40000.0 / 1200), 9) AS back, round(r / (r + 1), 9) AS flux FROM t""")
def rarity_light(spark, d):
    r = F.least(F.greatest(F.col("p_retailprice") / 2500, F.lit(0.0)), F.lit(1.0))
    k = light.rarity_to_temperature(r)
    return table(spark, d, "part").select("p_partkey", F.round(k, 4).alias("kelvin"), F.round(light.temperature_to_rarity(k), 9).alias("back"), F.round(light.naka_rushton(r), 9).alias("flux"))


@query("""WITH p AS (SELECT vec_id, radians(embedding[1]::DOUBLE * 30) AS a, radians(embedding[2]::DOUBLE * 90) AS b, radians(embedding[3]::DOUBLE * 30) AS c, radians(embedding[4]::DOUBLE * 90) AS e FROM embeddings)
SELECT vec_id, round(degrees(acos(least(greatest(sin(a) * sin(c) + cos(a) * cos(c) * cos(e - b), -1), 1))), 6) AS far FROM p""")
def great_circles(spark, d):
    at = lambda i, s: F.radians(F.col("embedding")[i].cast("double") * s)
    return table(spark, d, "embeddings").select("vec_id", F.round(great_circle_deg(at(0, 30), at(1, 90), at(2, 30), at(3, 90)), 6).alias("far"))


@query("""SELECT CAST(i AS DOUBLE) AS jd, CAST(floor(m / 30) AS INT) AS rahu_sign, round(m, 6) AS rahu_lon FROM (SELECT i, x - 360 * floor(x / 360) AS m FROM
(SELECT i, (n - 360 * floor(n / 360)) - a AS x FROM (SELECT i, 125.04452 - 0.05295377 * (i - 2451545.0) AS n, 23.85709235 + (5029.0966 * t + 1.11113 * t * t - 0.000006 * t * t * t) / 3600.0 AS a FROM (SELECT i, (i - 2451545.0) / 36525.0 AS t FROM range(2440000, 2444000) r(i)))))""")
def ephem_signs(spark, d):
    days = spark.range(2440000, 2444000).select(F.col("id").cast("double").alias("jd"))
    rows = sidereal(days)
    return rows.select("jd", zodiac.sign_of(F.col("rahu_lon")).alias("rahu_sign"), F.round("rahu_lon", 6).alias("rahu_lon"))


@query()
def positions_daily(spark, d):
    from skyloom.sources.positions import positions

    return positions(spark, 2446067.0, 2449719.0)


@query(f"SELECT vec_id AS id, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) AS potential FROM embeddings")
def latent_potential(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(norm(F.col("embedding")), 6).alias("potential"))
