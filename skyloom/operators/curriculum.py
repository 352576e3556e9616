"""Training windows by epoch: sweeps over a whole span, then bursts at drawn places, dealt to workers and drawn alike at every start.

Times are whole microseconds. A window has ``length`` frames of one stride each; a phase's stride falls from epoch to epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND


@dataclass(frozen=True)
class Phase:
    """``bursts`` of ``span_days`` each at drawn places; 0 bursts sweep the whole span once."""

    name: str
    stride_seconds: int
    bursts: int = 0
    span_days: float = 0.0

    @property
    def stride(self) -> int:
        return self.stride_seconds * SECOND


# The first epoch of each phase, its stride, bursts and their days (a half, a twelfth of 365.25 days, a week).
SCHEDULE = [
    (0, Phase("solar", 86400)),
    (5, Phase("ascendant", 7200)),
    (10, Phase("navamsha", 1440, 1000, 365.25 / 2)),
    (15, Phase("degree", 240, 2000, 365.25 / 12)),
    (20, Phase("quantum", 24, 5000, 7.0)),
]


def phase_of(epoch: int) -> Phase:
    """The phase of an epoch, counted from 0; negative epochs have the first."""
    return [phase for first, phase in SCHEDULE if first <= max(epoch, 0)][-1]


@dataclass(frozen=True)
class Plan:
    """One epoch's windows over [start, end], in microseconds: ``length`` frames each, a new one every ``hop`` frames."""

    phase: Phase
    epoch: int
    start: int
    end: int
    length: int
    hop: int
    workers: int = 1
    seed: int = 0

    @property
    def per_sweep(self) -> int:
        """Windows that lie whole in the span, or in one burst."""
        span = int(self.phase.span_days * DAY) if self.phase.bursts else self.end - self.start
        ticks = span // self.phase.stride + 1
        return max(0, (ticks - self.length) // self.hop + 1)

    @property
    def size(self) -> int:
        """Microseconds of a window."""
        return self.length * self.phase.stride


def windows(spark: SparkSession, plan: Plan) -> DataFrame:
    """(window, worker, begin): numbered from 0, each once, computed from its number alone.

    A sweep deals windows to workers in turn, bursts are dealt whole. A burst begins at start + u * room, u being the
    first 52 bits of the MD5 of "seed:epoch:burst" as a fraction; where the span is shorter than a burst, room is 0.
    """
    step = plan.hop * plan.phase.stride
    if not plan.phase.bursts:
        ids = spark.range(plan.per_sweep).withColumnRenamed("id", "window")
        return ids.select("window", (F.col("window") % plan.workers).alias("worker"), (F.lit(plan.start) + F.col("window") * step).alias("begin"))
    ids = spark.range(plan.phase.bursts * plan.per_sweep).withColumnRenamed("id", "window")
    burst = F.floor(F.col("window") / plan.per_sweep) if plan.per_sweep else F.col("window")
    room = max(0, plan.end - int(plan.phase.span_days * DAY) - plan.start)
    text = F.concat(F.lit(f"{plan.seed}:{plan.epoch}:"), burst.cast("string"))
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)
    anchor = F.lit(plan.start) + F.floor(drawn * float(room))
    return ids.select("window", (burst % plan.workers).alias("worker"), (anchor + (F.col("window") - burst * plan.per_sweep) * step).alias("begin"))


def dealt(found: DataFrame, worker: int, done: int = -1) -> DataFrame:
    """What a worker still has to do behind the window ``done``, the last it finished."""
    return found.where((F.col("worker") == worker) & (F.col("window") > done))


def _frames_of_sweep(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows are summed by tick first; a tick has at most ceil(length / hop) windows."""
    tick = F.floor((F.col("_at") - plan.start) / plan.phase.stride)
    ticks = rows.where(F.col("_at") >= plan.start).groupBy(tick.alias("_tick")).agg(F.count("*").alias("n"), F.sum("_value").alias("total"))
    low = F.greatest(F.floor((F.col("_tick") - plan.length) / plan.hop) + 1, F.lit(0))
    high = F.least(F.floor(F.col("_tick") / plan.hop), F.lit(plan.per_sweep - 1))
    spread = ticks.where(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    return spread.select("window", (F.col("_tick") - F.col("window") * plan.hop).alias("frame"), "n", "total")


def _frames_of_bursts(rows: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """Rows and windows meet in slots of a window's size, of which a window touches two at most; sums are partial before they are sent."""
    size = plan.size
    slots = F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("begin") + size - 1) / size))
    spread = found.select("window", "begin", F.explode(slots).alias("_slot"))
    met = rows.withColumn("_slot", F.floor(F.col("_at") / size)).join(spread, "_slot").where((F.col("_at") >= F.col("begin")) & (F.col("_at") < F.col("begin") + size))
    frame = F.floor((F.col("_at") - F.col("begin")) / plan.phase.stride)
    return met.groupBy("window", frame.alias("frame")).agg(F.count("*").alias("n"), F.sum("_value").alias("total"))


def samples(rows: DataFrame, plan: Plan, at: Column, value: Column) -> DataFrame:
    """Every window with its frames: (window, worker, begin, frames), frames being (frame, n, total) in order, empty frames left out.

    ``at`` is in microseconds. Rows without a time are in no window; a null value counts in n, not in total. A window
    without rows has an empty array. Rows behind the span can be in the last frame of a window, as it is a whole stride.
    """
    found = windows(rows.sparkSession, plan)
    timed = rows.select(at.alias("_at"), value.cast("double").alias("_value")).where(F.col("_at").isNotNull())
    frames = _frames_of_bursts(timed, found, plan) if plan.phase.bursts else _frames_of_sweep(timed, plan)
    lists = frames.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("frame", "n", "total"))).alias("frames"))
    empty = F.array().cast("array<struct<frame:bigint,n:bigint,total:double>>")
    return found.join(lists, "window", "left").select("window", "worker", "begin", F.coalesce("frames", empty).alias("frames"))
