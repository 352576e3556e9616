"""The sky of one instant as an array, for sequential kernels: the same elements as ``sources.ephemeris``, in numpy."""

from __future__ import annotations

import numpy as np

from skyloom.functions.calendar import J2000
from skyloom.sources import ephemeris as E


def _planet(name: str, t: float) -> np.ndarray:
    a, e, inc, mean, peri, node = (b + r * t for b, r in zip(*E.ELEMENTS[name], strict=True))
    m = np.radians((mean - peri + 180) % 360 - 180)
    x = m + e * np.sin(m)
    for _ in range(E.NEWTON_STEPS):
        x -= (x - e * np.sin(x) - m) / (1 - e * np.cos(x))
    plane = np.array([a * (np.cos(x) - e), a * np.sqrt(1 - e * e) * np.sin(x), 0.0])
    w, i, n = np.radians(peri - node), np.radians(inc), np.radians(node)
    about_z = lambda q: np.array([[np.cos(q), -np.sin(q), 0], [np.sin(q), np.cos(q), 0], [0, 0, 1]])
    about_x = np.array([[1, 0, 0], [0, np.cos(i), -np.sin(i)], [0, np.sin(i), np.cos(i)]])
    return about_z(n) @ about_x @ about_z(w) @ plane


def directions(jd: float) -> np.ndarray:
    """Unit vectors of the bodies in their order, (10, 3)."""
    d, t = jd - J2000, (jd - J2000) / 36525
    earth = _planet("Earth", t)
    arg = {k: np.radians(a + b * d) for k, (a, b) in E.MOON_ARGUMENTS.items()}
    series = lambda terms: sum(c * np.sin(p * arg["D"] + q * arg["M"] + r * arg["P"] + s * arg["F"]) for c, p, q, r, s in terms)
    lon = np.radians(E.MOON_ARGUMENTS["L"][0] + E.MOON_ARGUMENTS["L"][1] * d + series(E.MOON_LONGITUDE))
    lat = np.radians(series(E.MOON_LATITUDE))
    node = np.radians(E.NODE[0] + E.NODE[1] * d)
    shift = np.radians(23.85709235 + (5029.0966 * t + 1.11113 * t * t - 0.000006 * t**3) / 3600)
    flat = lambda q: np.array([np.cos(q), np.sin(q), 0.0])
    out = [-earth, np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])]
    out += [_planet(p, t) - earth for p in ("Mercury", "Venus", "Mars", "Jupiter", "Saturn")]
    out += [flat(node), flat(node + np.pi), flat(shift)]
    return np.array([v / np.sqrt(v @ v) for v in out])
