import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm import packing as pk
from tests.llm.common import DOCS, ODD, docs, prose, words


def fits(used, lengths):
    return next(c for c in lengths if c >= used)


def opened(size, later, lengths):
    """Every length tried on the sizes still to come, one item after the other."""
    prices = []
    for c in lengths:
        if c >= size:
            used = size
            for x in later:
                if used + x <= c:
                    used += x
            prices.append((pk.cost(fits(used, lengths)) / used, c))
    return min(prices)[1]


def naive(sizes, lengths, single=None):
    """Best fit by looking at every open bin."""
    bins = []
    for i, size in enumerate(sizes):
        room = [b for b in bins if b[0] >= size]
        if room:
            best = min(b[0] for b in room)
            b = max((b for b in room if b[0] == best), key=lambda b: b[2])
        else:
            b = [opened(size, sizes[i + 1 :], lengths) if single is None else fits(max(size, single), lengths), [], 0]
            bins.append(b)
        b[0] -= size
        b[1].append(i)
        b[2] = i + 1
    return sorted((fits(sum(sizes[i] for i in m), lengths), m) for _, m, _ in bins)


def total(bins):
    return sum(pk.cost(c) for c, _ in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_against_naive(sizes):
    sizes, lengths = sorted(sizes, reverse=True), (16, 32, 64)
    plans = [naive(sizes, lengths, single) for single in (None, *lengths)]
    got = sorted(pk.pack_lengths(sizes, lengths))
    assert got == min(plans, key=total)


@pytest.mark.parametrize("seed", range(4))
def test_no_dearer_than_any_single_length(seed):
    rng = random.Random(seed)
    sizes = sorted((int(rng.choice([rng.uniform(5, 2000), rng.expovariate(1 / 300) + 1])) for _ in range(3000)), reverse=True)
    sizes = [min(x, 8192) for x in sizes]
    got = pk.pack_lengths(sizes)
    assert sorted(i for _, m in got for i in m) == list(range(len(sizes)))
    for c in pk.LENGTHS:
        assert total(got) <= total([(fits(sum(sizes[i] for i in m), pk.LENGTHS), m) for m in pk._best_fit(sizes, pk.LENGTHS, c)])


def test_several_lengths_are_opened():
    sizes = sorted([700] * 40 + [300] * 40 + [90] * 100 + [1500] * 10, reverse=True)
    assert len({c for c, _ in pk.pack_lengths(sizes)}) > 1


def test_every_token_is_packed_once(spark):
    texts = [*ODD, *(prose(i, 7 * i) for i in range(60)), prose(7, 70), prose(7, 70)]
    bins = pk.pack(docs(spark, texts), (64, 128, 256)).collect()
    seen = Counter()
    for b in bins:
        assert b.used == sum(s.n_tokens for s in b.segments) <= b.capacity
        assert b.capacity == next(c for c in (64, 128, 256) if c >= b.used)
        assert b.doc_ids == [s.doc_id for s in b.segments]
        for s in b.segments:
            seen.update((s.doc_id, t) for t in range(s.start, s.start + s.n_tokens))
    assert seen == Counter((i, t) for i, x in enumerate(texts) for t in range(len(words(x)) + 1))
    assert len({b.bin_id for b in bins}) == len(bins)


def test_fill(spark):
    rng = random.Random(1)
    bins = pk.pack(docs(spark, [prose(i, rng.randint(5, 900)) for i in range(400)])).agg(F.sum("used"), F.sum("capacity")).first()
    assert bins[0] / bins[1] > 0.93  # four shards of a hundred texts


def test_empty_null_ids_and_repeats(spark):
    assert pk.pack(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = pk.pack(rows).collect()
    assert sum(b.used for b in got) == 3 + 2 + 2 + 1
    assert Counter(i for b in got for i in b.doc_ids) == {None: 2, 1: 2}


def test_one_row_again_and_again_is_spread(spark):
    rows = spark.createDataFrame([(7, "a b c", 1, "x")] * 400, "doc_id long, text string, row int, bucket string").coalesce(1)
    assert len({b.bin_id % 4 for b in pk.pack(rows, (64,)).collect()}) == 4


def test_a_length_must_hold_everything():
    with pytest.raises(ValueError):
        pk.pack_lengths([65], (64,))
