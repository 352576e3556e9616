"""The icosphere by addresses: triangles (face, path), their corners, neighbours and points, and its nodes.

A triangle of level k is one number: its face (0 to 19) and k base-4 digits, the first halving first. Digits 0, 1 and 2 are the
children at the first, second and third corner, 3 is the middle one, so ``shiftright(triangle, 2)`` is the parent and a roll-up
to a coarser mesh is a grouping. Within a face a point has whole weights of the three corners that add up to 2**k; a triangle's
centre has three times as many. Every step from an address to a place or back is a fold over the
levels, of one row alone: nothing is looked up, joined or gathered, whatever the level (at most ``DEEPEST``).
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Halvings whose addresses and node numbers fit into a long.
DEEPEST = 28


def _solid() -> tuple[list[tuple[float, ...]], list[tuple[int, int, int]]]:
    """The icosahedron's 12 unit corners and its 20 faces."""
    up = (1 + math.sqrt(5)) / 2
    size = math.sqrt(1 + up * up)
    corners = [tuple(c / size for c in p) for a in (-1.0, 1.0) for b in (-up, up) for p in ((0.0, a, b), (a, b, 0.0), (b, 0.0, a))]
    side = [frozenset(e) for e in combinations(range(12), 2) if math.dist(corners[e[0]], corners[e[1]]) < 1.1]
    return corners, [f for f in combinations(range(12), 3) if all(frozenset(e) in side for e in combinations(f, 2))]


CORNERS, FACES = _solid()
EDGES = sorted({e for f in FACES for e in combinations(f, 2)})


def _literal(values) -> Column:
    return F.array(*[_literal(v) if isinstance(v, (list, tuple)) else F.lit(v) for v in values])


def _across() -> list[list[list[int]]]:
    """By face and corner: the face behind the side opposite to it, and where in that one the side's two corners are."""
    out = []
    for f in FACES:
        row = []
        for c in f:
            side = [v for v in f if v != c]
            (g,) = [g for g in range(20) if set(side) <= set(FACES[g]) and FACES[g] != f]
            row.append([g, FACES[g].index(side[0]), FACES[g].index(side[1])])
        out.append(row)
    return out


def _level(levels: int) -> int:
    if not 0 <= levels <= DEEPEST:
        raise ValueError(f"levels are 0 to {DEEPEST}")
    return levels


def _dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _bound(values: dict[str, Column], then) -> Column:
    """then(struct of the values), each computed once for it."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then)[0]


def _middle(a: Column, b: Column) -> Column:
    return _bound({"s": F.array(*[a[i] + b[i] for i in range(3)])}, lambda t: F.transform(t["s"], lambda c: c / F.sqrt(_dot(t["s"], t["s"]))))


def _folded(start: Column, steps: Column, step) -> Column:
    return F.aggregate(steps, start, step)


def _downward(levels: int) -> Column:
    """Level numbers levels - 1 to 0."""
    return F.sequence(F.lit(levels - 1), F.lit(0)) if levels else F.array().cast("array<int>")


def _halved(t: Column, digit: Column) -> list[Column]:
    """The corners of a child of the triangle with corners t.a, t.b, t.c and side middles t.p (ab), t.q (bc), t.r (ca)."""
    rows = [(t["a"], t["p"], t["r"]), (t["p"], t["b"], t["q"]), (t["r"], t["q"], t["c"]), (t["p"], t["q"], t["r"])]
    pick = lambda i: F.when(digit == 0, rows[0][i]).when(digit == 1, rows[1][i]).when(digit == 2, rows[2][i]).otherwise(rows[3][i])
    return [pick(i) for i in range(3)]


def _with_middles(t: Column, then) -> Column:
    return _bound({"a": t["a"], "b": t["b"], "c": t["c"], "p": _middle(t["a"], t["b"]), "q": _middle(t["b"], t["c"]), "r": _middle(t["c"], t["a"])}, then)


def _face_corner(face: Column, i: int) -> Column:
    return F.element_at(_literal([CORNERS[f[i]] for f in FACES]), (face + 1).cast("int"))


def _face(triangle: Column, levels: int) -> Column:
    return F.shiftright(triangle, 2 * levels)


def _shifted(x: Column, k: Column) -> Column:
    """x >> 2k for a k that is a column."""
    return F.call_function("shiftright", x, (k * 2).cast("int"))


def triangle_corners(triangle: Column, levels: int) -> Column:
    """Struct (a, b, c) of the corners of a triangle of level ``levels``, unit vectors; null for null."""
    triangle = triangle.cast("long")
    face = _face(triangle, _level(levels))
    digits = F.transform(_downward(levels), lambda k: F.pmod(_shifted(triangle, k), F.lit(4)))
    start = F.struct(*[_face_corner(face, i).alias(n) for i, n in enumerate("abc")])

    def step(t, digit):
        return _with_middles(t, lambda m: F.struct(*[c.alias(n) for c, n in zip(_halved(m, digit), "abc", strict=True)]))

    return F.when(triangle.isNotNull(), _folded(start, digits, step))


def _descended(p: np.ndarray, levels: int) -> np.ndarray:
    """The triangles of unit vectors (rows)."""
    corners = np.array(CORNERS)[np.array(FACES)]
    face = (p @ corners.sum(1).T).argmax(1)
    at = face.astype(np.int64)
    a, b, c = (corners[face, i] for i in range(3))
    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
    middle = lambda u, v: (u + v) / np.sqrt(dot(u + v, u + v))[:, None]
    for _ in range(levels):
        ab, bc, ca = middle(a, b), middle(b, c), middle(c, a)
        side = np.stack([dot(n, p) * dot(n, corner) > 0 for n, corner in ((np.cross(ab, ca), a), (np.cross(ab, bc), b), (np.cross(ca, bc), c))])
        digit = np.where(side.any(0), side.argmax(0), 3)
        at = at * 4 + digit
        which = digit[:, None]
        a, b, c = (np.select([which == i for i in range(3)], own, last) for own, last in (((a, ab, ca), ab), ((ab, b, bc), bc), ((ca, bc, c), ca)))
    return at


def triangle_at(x: Column, y: Column, z: Column, levels: int) -> Column:
    """The triangle of level ``levels`` that holds a direction; null if it is null, zero or not finite.

    The face is that of the nearest face centre (ties: the first), then each level asks which side of the three middle
    arcs the point is on; a point on an arc is the middle child's. The descent runs in Arrow batches: as nested array
    functions, which are not compiled, it took twelve times as long (200,000 rows, 8 levels).
    """
    _level(levels)

    @F.pandas_udf("long")
    def descend(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        p = np.stack([v.to_numpy(float, na_value=np.nan) for v in (x, y, z)], axis=1)
        size = np.abs(p).max(1, initial=0)
        good = np.isfinite(size) & (size > 0)
        out = np.zeros(len(p), np.int64)
        unit = p[good] / size[good, None]
        out[good] = _descended(unit / np.sqrt((unit * unit).sum(1))[:, None], levels)
        return pd.Series(out, dtype="Int64").mask(~good)

    return descend(*(c.cast("double") for c in (x, y, z)))


def triangle_of(lat_deg: Column, lng_deg: Column, levels: int) -> Column:
    """The triangle that holds a place on the ground."""
    lat, lng = F.radians(lat_deg.cast("double")), F.radians(lng_deg.cast("double"))
    return triangle_at(F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat), levels)


def _weights(triangle: Column, levels: int) -> Column:
    """Array of the centre's weights, which add up to 3 * 2**levels; from the last digit to the first."""

    def step(w, k):
        h = F.call_function("shiftleft", F.lit(3).cast("long"), k.cast("int"))

        def grown(t):
            i, j, l, d = t["w"][0], t["w"][1], t["w"][2], t["d"]
            outer = F.array(F.when(d == 0, i + h).otherwise(i), F.when(d == 1, j + h).otherwise(j), F.when(d == 2, l + h).otherwise(l))
            return F.when(d == 3, F.array(h - j, h - l, h - i)).otherwise(outer)

        return _bound({"w": w, "d": F.pmod(_shifted(triangle, k), F.lit(4))}, grown)

    one = F.lit(1).cast("long")
    upward = F.sequence(F.lit(0), F.lit(levels - 1)) if levels else F.array().cast("array<int>")
    return _folded(F.array(one, one, one), upward, step)


def _address(face: Column, weights: Column, levels: int) -> Column:
    """The triangle whose centre has these weights in a face: the inverse of ``_weights``."""

    def step(t, k):
        h = F.call_function("shiftleft", F.lit(3).cast("long"), k.cast("int"))
        i, j, l = t["w"][0], t["w"][1], t["w"][2]
        digit = F.when(i > h, 0).when(j > h, 1).when(l > h, 2).otherwise(3)
        inner = F.when(i > h, F.array(i - h, j, l)).when(j > h, F.array(i, j - h, l)).when(l > h, F.array(i, j, l - h)).otherwise(F.array(h - l, h - i, h - j))
        return F.struct(inner.alias("w"), (t["at"] * 4 + digit).alias("at"))

    return _folded(F.struct(weights.alias("w"), face.cast("long").alias("at")), _downward(levels), step)["at"]


def triangle_neighbours(triangle: Column, levels: int) -> Column:
    """Array of the three triangles behind the sides opposite to the first, second and third weight; null for null."""
    triangle = triangle.cast("long")
    face = _face(triangle, _level(levels))
    across = _literal(_across())

    def beside(t, c):
        w, a, b = t["w"], (c + 1) % 3, (c + 2) % 3
        step = F.when(w[0] % 3 == 1, F.lit(1)).otherwise(F.lit(-1))
        moved = F.array(*[(w[i] - 2 * step if i == c else w[i] + step) for i in range(3)])
        there = F.element_at(F.element_at(across, (t["f"] + 1).cast("int")), c + 1)
        first, second = sorted((a, b))
        other = F.array(*[F.when(there[1] == i, w[first]).when(there[2] == i, w[second]).otherwise(F.lit(1).cast("long")) for i in range(3)])
        out = (w[c] == 1) & (w[0] % 3 == 1)
        return F.when(out, _address(there[0], other, levels)).otherwise(_address(t["f"], moved, levels))

    found = _bound({"w": _weights(triangle, levels), "f": face}, lambda t: F.array(*[beside(t, c) for c in range(3)]))
    return F.when(triangle.isNotNull(), found)


def triangles(spark: SparkSession, levels: int) -> DataFrame:
    """(triangle, a, b, c): all 20 * 4**levels triangles with their corners."""
    at = triangle_corners(F.col("triangle"), levels)
    return spark.range(20 * 4 ** _level(levels)).select(F.col("id").alias("triangle")).select("triangle", at.alias("t")).select("triangle", "t.*")


def _whole_root(x: Column) -> Column:
    """The greatest r with r * (r + 1) / 2 <= x: the row of the x-th point of a triangle of points."""
    near = F.floor((F.sqrt(8 * x.cast("double") + 1) - 1) / 2).cast("long")
    low = F.when(near * (near + 1) / 2 > x, near - 1).otherwise(near)
    return F.when((low + 1) * (low + 2) / 2 <= x, low + 1).otherwise(low)


def node_points(spark: SparkSession, levels: int) -> DataFrame:
    """(node, x, y, z): the 10 * 4**levels + 2 nodes, each made from its number alone.

    Numbers 0 to 11 are the solid's corners, then the inner points of its 30 edges, then those of its 20 faces, so that no
    point comes from two faces and none has to be dropped.
    """
    n = 2 ** _level(levels)
    per_edge, per_face = max(n - 1, 0), (n - 1) * (n - 2) // 2
    node = F.col("id")
    e, f = node - 12, node - 12 - 30 * per_edge
    corner_face = [next(i for i, g in enumerate(FACES) if v in g) for v in range(12)]
    edge_face = [next(i for i, g in enumerate(FACES) if set(s) <= set(g)) for s in EDGES]
    unit = lambda i: [n if j == i else 0 for j in range(3)]
    of = lambda values, at: F.element_at(_literal(values), (at + 1).cast("int"))
    long = lambda c: c.cast("long")
    # Corners: all weight on one. Edges: s on the second, the rest on the first. Faces: rows of 1, 2, 3, ... points.
    at_corner = F.struct(long(of(corner_face, node)).alias("f"), of([unit(FACES[corner_face[v]].index(v)) for v in range(12)], node).cast("array<long>").alias("w"))
    kinds = [at_corner]
    if per_edge:
        edge, s = F.floor(e / per_edge), e % per_edge + 1
        ends = of([[FACES[g].index(s) for s in pair] for g, pair in zip(edge_face, EDGES, strict=True)], edge)
        weight = F.array(*[long(F.when(ends[0] == i, n - s).when(ends[1] == i, s).otherwise(F.lit(0))) for i in range(3)])
        kinds.append(F.struct(long(of(edge_face, edge)).alias("f"), weight.alias("w")))
    if per_face:
        inner = _bound({"r": _whole_root(f % per_face), "m": long(f % per_face)}, lambda t: F.array(n - 2 - t["r"], long(t["m"] - t["r"] * (t["r"] + 1) / 2) + 1, t["r"] - long(t["m"] - t["r"] * (t["r"] + 1) / 2) + 1))
        kinds.append(F.struct(long(F.floor(f / per_face)).alias("f"), inner.alias("w")))
    begins = [0, 12, 12 + 30 * per_edge]
    place = reduce(lambda got, more: F.when(node >= more[1], more[0]).otherwise(got), zip(kinds[1:], begins[1:], strict=False), kinds[0])

    def step(t, k):
        h = F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))

        def child(m):
            i, j, l = t["w"][0], t["w"][1], t["w"][2]
            digit = F.when(i >= h, 0).when(j >= h, 1).when(l >= h, 2).otherwise(3)
            inner = F.when(i >= h, F.array(i - h, j, l)).when(j >= h, F.array(i, j - h, l)).when(l >= h, F.array(i, j, l - h)).otherwise(F.array(h - l, h - i, h - j))
            return _bound({"d": digit}, lambda s: F.struct(*[c.alias(c_) for c, c_ in zip(_halved(m, s["d"]), "abc", strict=True)], inner.alias("w")))

        return _with_middles(t, child)

    rows = spark.range(10 * 4**levels + 2).select(node.alias("node"), place.alias("p"))
    start = F.struct(*[_face_corner(F.col("p.f"), i).alias(c) for i, c in enumerate("abc")], F.col("p.w").alias("w"))
    found = rows.select("node", _folded(start, _downward(levels), step).alias("t"))
    w = F.col("t.w")
    end = F.when(w[0] == 1, F.col("t.a")).when(w[1] == 1, F.col("t.b")).otherwise(F.col("t.c"))
    return found.select("node", end.alias("v")).select("node", *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")])
