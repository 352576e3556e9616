"""The kernels of density clusters measure few pairs, with the same numbers as a loop over all of them."""

import numpy as np
import pytest

from skyloom.operators import density


def all_pairs(x, y):
    return np.array([density.squares(y.T.copy(), v) for v in x])


def slow_tree(x, core, ids):
    """Kruskal over all pairs in order of (reach, a, b)."""
    d = np.maximum(np.maximum(np.sqrt(all_pairs(x, x)), core), core[:, None])
    edges = sorted((d[i, j], *sorted((ids[i], ids[j])), i, j) for i in range(len(x)) for j in range(i))
    up, out = list(range(len(x))), []

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for w, a, b, i, j in edges:
        i, j = top(i), top(j)
        if i != j:
            up[i] = j
            out.append((a, b, w))
    return sorted(out)


def cases():
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(90, 7))
    yield "plain", plain
    yield "copies", np.repeat(plain[:30], 3, axis=0)
    yield "lattice", rng.integers(0, 4, (90, 2)).astype(float)
    yield "far away", plain * 1e-3 + 1e7
    yield "tiny", plain * 1e-170
    yield "huge", plain * 1e200
    yield "some huge", np.where(np.arange(90)[:, None] % 9 == 0, 1e160, 1.0) * plain


@pytest.mark.parametrize("name, x", list(cases()))
@pytest.mark.filterwarnings("ignore:overflow", "ignore:invalid")
def test_the_same_as_a_loop(name, x):
    want = np.sqrt(np.sort(all_pairs(x[:50], x), axis=1)[:, :5])
    assert np.array_equal(density.least_distances(x[:50].T.copy(), x.T.copy(), 5), want)
    core, ids = np.sqrt(np.sort(all_pairs(x, x), axis=1)[:, 4]), np.random.default_rng(4).permutation(len(x))
    assert sorted(zip(*(v.tolist() for v in density.spanning_tree(x.T.copy(), core, ids)))) == slow_tree(x, core, ids)


def test_few_pairs_are_measured(monkeypatch):
    x = np.random.default_rng(5).normal(size=(700, 16))
    measured, plain, exact = [0], density.squares, getattr(density, "_exact", None)

    def counted(xt, v):
        measured[0] += xt.shape[1]
        return plain(xt, v)

    def counted_rows(a, b):
        measured[0] += len(a)
        return exact(a, b)

    monkeypatch.setattr(density, "squares", counted)
    monkeypatch.setattr(density, "_exact", counted_rows, raising=False)
    core = density.least_distances(x.T.copy(), x.T.copy(), 8)[:, -1]
    density.spanning_tree(x.T.copy(), core, np.arange(700))
    assert measured[0] < 700 * 700 / 10
