"""Windows by epoch against plain loops."""

import hashlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skyloom.operators import curriculum as c

SWEEP = c.Plan(c.Phase("sweep", 10), 7, 1_000_000, 1_000_000 + 200_000_000, length=4, hop=3, workers=3)
BURSTS = c.Plan(c.Phase("bursts", 2, 9, 30 / 86400), 21, 1_000_000, 1_000_000 + 200_000_000, length=5, hop=2, workers=2, seed=11)


def planned(plan):
    stride, out = plan.phase.stride, []
    if not plan.phase.bursts:
        total, w0 = (plan.end - plan.start) // stride + 1, 0
        while w0 + plan.length <= total:
            out.append((len(out), len(out) % plan.workers, plan.start + w0 * stride))
            w0 += plan.hop
        return out
    span = int(plan.phase.span_days * c.DAY)
    for burst in range(plan.phase.bursts):
        u = int(hashlib.md5(f"{plan.seed}:{plan.epoch}:{burst}".encode()).hexdigest()[:13], 16) / 2**52
        anchor, w0 = plan.start + int(u * max(0, plan.end - span - plan.start)), 0
        while w0 + plan.length <= span // stride + 1:
            out.append((len(out), burst % plan.workers, anchor + w0 * stride))
            w0 += plan.hop
    return out


def test_phases():
    assert [c.phase_of(e).name for e in (0, 4, 5, 9, 10, 14, 15, 19, 20, 99)] == ["solar"] * 2 + ["ascendant"] * 2 + ["navamsha"] * 2 + ["degree"] * 2 + ["quantum"] * 2
    strides = [p.stride_seconds for _, p in c.SCHEDULE]
    assert strides == sorted(strides, reverse=True)


@pytest.mark.parametrize("plan", [SWEEP, BURSTS, replace(BURSTS, end=2_000_000), replace(SWEEP, end=2_000_000)])
def test_windows(spark, plan):
    got = sorted(map(tuple, c.windows(spark, plan).collect()))
    assert got == planned(plan) and len({w for w, _, _ in got}) == len(got)


@pytest.mark.parametrize("plan", [SWEEP, BURSTS])
def test_workers_and_restarts_lose_and_double_nothing(spark, plan):
    whole = sorted(map(tuple, c.windows(spark, plan).collect()))
    parts = []
    for worker in range(plan.workers):
        own = sorted(map(tuple, c.dealt(c.windows(spark, plan), worker).collect()))
        done = own[len(own) // 2][0]
        rest = sorted(map(tuple, c.dealt(c.windows(spark, plan), worker, done).collect()))
        assert [r for r in own if r[0] <= done] + rest == own
        parts += own
    assert sorted(parts) == whole


def test_another_seed_or_epoch_draws_other_places(spark):
    places = [{r.begin for r in c.windows(spark, p).collect()} for p in (BURSTS, replace(BURSTS, seed=12), replace(BURSTS, epoch=22))]
    assert places[0] != places[1] != places[2] != places[0]


@pytest.mark.parametrize("plan", [SWEEP, BURSTS])
def test_samples(spark, plan):
    """A third of the rows at one instant, ties, null times and values, times before and behind the span, a clashing column."""
    draw = random.Random(5)
    rows = [(draw.randrange(-20, 240) * 1_000_000 + draw.randrange(3), draw.choice([1.0, 4.0, None]), 1) for _ in range(200)]
    rows += [(50_000_000, 2.0, 1)] * 100 + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "t long, v double, window int")
    want = {}
    for w, worker, begin in planned(plan):
        frames = {}
        for t, v, _ in rows:
            if t is not None and begin <= t < begin + plan.size:
                frames.setdefault((t - begin) // plan.phase.stride, []).append(v)
        want[w] = (worker, begin, [(f, len(vs), sum(v for v in vs if v is not None) if any(v is not None for v in vs) else None) for f, vs in sorted(frames.items())])
    got = {r.window: (r.worker, r.begin, [tuple(f) for f in r.frames]) for r in c.samples(df, plan, F.col("t"), F.col("v")).collect()}
    assert got == want
    none = c.samples(df.where("t > 1e17"), plan, F.col("t"), F.col("v")).collect()
    assert len(none) == len(want) and all(r.frames == [] for r in none)
