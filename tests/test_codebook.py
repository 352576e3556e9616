"""Codebook training against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import codebook as c

KIND = "id long, vec array<double>, macro string"


def spread(n=240, d=3, seed=4):
    """Vectors about six places; a third of the rows are one vector."""
    draw = np.random.default_rng(seed)
    places = draw.normal(size=(6, d)) * 5
    x = places[draw.integers(0, 6, n)] + draw.normal(size=(n, d))
    x[: n // 3] = x[0]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], KIND).repartition(5)


def random_book(x, k, m, seed=2):
    draw = np.random.default_rng(seed)
    return c.Book.of(x[draw.choice(len(x), k, replace=False)].copy(), draw.uniform(1, 5, k), draw.normal(size=(k, m, x.shape[1])), draw.uniform(1, 5, (k, m)))


def looped(book, x, decay, eps):
    """One step, row by row."""
    k, m, d = book.micro.shape
    n, whole, rest, far, left = np.zeros((k, m)), np.zeros((k, d)), np.zeros((k, m, d)), 0.0, 0.0
    for v in x:
        a = [((v - q) ** 2).sum() for q in book.macro]
        i = int(np.argmin(a))
        r = v - book.macro[i]
        b = [((r - q) ** 2).sum() for q in book.micro[i]]
        j = int(np.argmin(b))
        n[i, j] += 1
        whole[i] += v
        rest[i, j] += r
        far, left = far + a[i], left + b[j]
    size, total = decay * book.macro_size + (1 - decay) * n.sum(1), decay * book.macro_sum + (1 - decay) * whole
    macro = np.array([total[i] / ((size[i] + eps) / (size.sum() + k * eps) * size.sum()) for i in range(k)])
    ms, mt = decay * book.micro_size + (1 - decay) * n, decay * book.micro_sum + (1 - decay) * rest
    return macro, size, mt / (ms + eps)[..., None], ms, (len(x), far, left)


def test_steps_equal_a_loop(spark):
    x = spread()
    book, rows = random_book(x, 5, 3), frame(spark, x)
    for turn in range(3):
        want = looped(book, x, 0.7, 1e-5)
        book = c.step(book, rows, decay=0.7, turn=turn)
        for got, w in zip((book.macro, book.macro_size, book.micro, book.micro_size, book.found), want, strict=True):
            np.testing.assert_allclose(got, w, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("decay", [0.0, 0.6, 0.99])
def test_distance_to_the_macro_codes_never_rises(spark, decay):
    """The mean of old and new place weighs a code's old place with its rows', so each step lowers the squared distance."""
    x = spread(seed=8)
    book, rows, seen = random_book(x, 4, 2), frame(spark, x), []
    for _ in range(4):
        book = c.step(book, rows, decay=decay, eps=0.0)
        seen.append(book.found[1])
    assert all(b <= a * (1 + 1e-12) for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] < seen[0]


def test_training_resumes(spark, tmp_path):
    rows = frame(spark, spread())
    whole = c.train(rows, str(tmp_path / "a"), 4, 3, steps=4, batches=2, decay=0.5, least=0.02)
    c.train(rows, str(tmp_path / "b"), 4, 3, steps=2, batches=2, decay=0.5, least=0.02)
    assert c.stored(spark, str(tmp_path / "b"))[0] == 2
    again = c.train(rows, str(tmp_path / "b"), 4, 3, steps=4, batches=2, decay=0.5, least=0.02)
    for name in ("macro", "macro_size", "micro", "micro_size", "found"):
        np.testing.assert_allclose(getattr(again, name), getattr(whole, name), rtol=1e-9, atol=1e-9)
    assert c.stored(spark, str(tmp_path / "a"))[0] == 4


def test_seeds_cover_the_places(spark):
    """Six places far from one another: the seeds' distance is within a tenth of that of the best means."""
    draw = np.random.default_rng(1)
    places = np.array([[i * 40.0, (i % 2) * 40.0] for i in range(6)])
    x = np.concatenate([p + draw.normal(size=(40, 2)) for p in places])
    got = c.seeds(frame(spark, x), 6, 2, seed=3)
    best = sum(((x[i * 40 : i * 40 + 40] - x[i * 40 : i * 40 + 40].mean(0)) ** 2).sum() for i in range(6))
    assert got.shape == (6, 2) and c._nearest(x, got)[1].sum() < 1.1 * best


def test_dead_codes_restart(spark):
    x = spread()
    book = random_book(x, 4, 2)
    book.macro[1], book.macro_sum[1], book.macro_size[1] = 1e6, 1e6 * 1e-3, 1e-3
    new = c.step(book, frame(spark, x), decay=0.5, least=0.01, seed=1, turn=1)
    assert new.macro_size[1] == 1.0 and any(np.array_equal(new.macro[1], v) for v in x)
    micro = c.dead(c.moved(book, np.zeros((4, 2), int), np.zeros((4, 3)), np.zeros((4, 2, 3)), 1.0, 1e-5), 0.01)[1]
    assert micro.shape[1] == 2
    # With fewer rows than dead codes the others stay.
    kept = c.restarted(random_book(x, 4, 2), x[:1], book.macro, 2.0)
    assert np.array_equal(kept.macro[0], x[0]) and not np.array_equal(kept.macro[1], x[0])


def test_codes_of_every_row(spark):
    x = spread(60)
    book = random_book(x, 4, 3)
    got = {r.id: r for r in c.coded(frame(spark, x), book).collect()}
    for i, v in enumerate(x):
        a = ((book.macro - v) ** 2).sum(1)
        b = ((book.micro[a.argmin()] - (v - book.macro[a.argmin()])) ** 2).sum(1)
        assert (got[i].macro, got[i].micro) == (a.argmin(), b.argmin()) and got[i].error == pytest.approx(b.min())


def test_odd_rows(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i % 7 if i % 3 else None, [float(draw.randrange(3)), 1.0], "x") for i in range(60)]
    rows += [(100, None, "x"), (101, [], "x"), (102, [1.0], "x"), (103, [float("nan"), 0.0], "x"), (104, [None, 1.0], "x"), (105, [float("inf"), 0.0], "x")]
    df = spark.createDataFrame(rows, KIND)
    book = c.train(df, str(tmp_path / "odd"), k=8, m=4, steps=2, decay=0.5)
    assert len(book.macro) == 3 and book.found[0] == 60 and book.found[2] == pytest.approx(0, abs=1e-6)
    got = c.coded(df, book).collect()
    assert len(got) == 66 and all((r.macro is None) == (r.id is not None and r.id >= 100) for r in got)
    assert c.train(df.where("id > 1000"), str(tmp_path / "none"), 4, 4) is None
    assert c.train(df.where("id = 100"), str(tmp_path / "null"), 4, 4) is None
    same = c.train(df.where("id < 7").withColumn("vec", F.array(F.lit(2.0))), str(tmp_path / "same"), 4, 4, steps=1, decay=0.0)
    assert same.macro.shape == (1, 1) and same.macro[0, 0] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        c.start(df, 1000, 1000)
