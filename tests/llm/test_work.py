import random

import numpy as np

from skyloom.llm import textkit as tk
from skyloom.llm import work


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(500, x) for x in range(501, 560)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted([find(a), find(b)])
        up[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = work.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)
    assert work.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packed_arrays_come_back():
    arrays = [np.arange(5), np.zeros(0, np.uint64), np.array([1.5, -2.0]), np.array([True, False]), np.arange(3, dtype=np.uint16)]
    for a, b in zip(arrays, work.unpack(work.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_words_and_hashes_do_not_depend_on_slices():
    import pyarrow as pa

    texts = ["a bb  ccc\n", None, "", "ddd", " x"] * 50
    data, offsets = tk.text_buffer(pa.array(texts))
    whole = tk.Words(data, offsets)
    parts = [tk.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1]) for a, b in tk.slices(offsets, 20)]
    assert (np.concatenate([p.hashes() for p in parts]) == whole.hashes()).all()
    assert whole.counts.tolist() == [3, 0, 0, 1, 1] * 50
    assert bytes(whole.spaced()[0][:9]) == b"a bb ccc "


def test_set_folder_is_used(spark):
    df = work.stored(spark.range(5), "numbers")
    assert df.count() == 5
    work.discard(df)
