"""Lossless maps between latents and light: spectra of four bands, spherical relief, vector fields.

Bases are small matrices; a frame's latents are one array, so each map is one
matrix product per batch. Fields are one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.aspects import BAND_PERIOD

BANDS = tuple(BAND_PERIOD)
SAMPLES, MODES = 96, 64


def band_basis(samples: int = SAMPLES) -> np.ndarray:
    """An orthonormal row for each band: the polynomials of degree 0 to 3 on an even grid."""
    q, r = np.linalg.qr(np.vander(np.linspace(-1, 1, samples), len(BANDS), increasing=True))
    return (q * np.sign(np.diag(r))).T


def emit(energies: dict[str, Column], samples: int = SAMPLES) -> Column:
    """The spectrum that four band energies add up to."""
    basis = band_basis(samples)
    return F.array(*[sum((energies[b] * float(basis[i, s]) for i, b in enumerate(BANDS[1:], 1)), energies[BANDS[0]] * float(basis[0, s])) for s in range(samples)])


def recover(spectrum: Column, samples: int = SAMPLES) -> dict[str, Column]:
    """The band energies of a spectrum."""
    basis = band_basis(samples)
    row = lambda i: F.array(*[F.lit(float(x)) for x in basis[i]])
    return {b: F.aggregate(F.zip_with(spectrum, row(i), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for i, b in enumerate(BANDS)}


def modes(n: int = MODES) -> list[tuple[int, int]]:
    degree = int(np.ceil(np.sqrt(n)))
    return [(d, m) for d in range(degree) for m in range(-d, d + 1)][:n]


def legendre(degree: int, x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Associated Legendre functions up to a degree, normalised over the sphere, without the alternating sign."""
    p = {(0, 0): np.full_like(x, np.sqrt(1 / (4 * np.pi)))}
    s = np.sqrt(1 - x * x)
    for m in range(1, degree + 1):
        p[m, m] = np.sqrt((2 * m + 1) / (2 * m)) * s * p[m - 1, m - 1]
    for m in range(degree + 1):
        for d in range(m + 1, degree + 1):
            a = np.sqrt((4 * d * d - 1) / (d * d - m * m))
            below = np.sqrt(((d - 1) ** 2 - m * m) / (4 * (d - 1) ** 2 - 1)) * p[d - 2, m] if d - 2 >= m else 0.0
            p[d, m] = a * (x * p[d - 1, m] - below)
    return p


def sphere(n: int = MODES, rings: int = 16, columns: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(basis, weights): real spherical harmonics at Gauss-Legendre rings, and the weights that integrate their products exactly."""
    x, w = np.polynomial.legendre.leggauss(rings)
    phi = 2 * np.pi * np.arange(columns) / columns
    p = legendre(modes(n)[-1][0], x)
    turn = lambda m: np.ones(columns) if m == 0 else np.sqrt(2) * (np.cos(m * phi) if m > 0 else np.sin(-m * phi))
    basis = np.stack([np.outer(p[d, abs(m)], turn(m)).ravel() for d, m in modes(n)])
    return basis, np.repeat(w, columns) * 2 * np.pi / columns


def _product(df: DataFrame, column: str, out: str, matrix: np.ndarray) -> DataFrame:
    """Adds out = matrix @ column for every row."""
    others = [c for c in df.columns if c != out]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            v = np.array(batch.column(column).to_pylist(), float).reshape(batch.num_rows, -1)
            made = v @ matrix.T if batch.num_rows else np.zeros((0, len(matrix)))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(matrix)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()))], names=[*others, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(others).schema)
    return df.select(others).mapInArrow(run, f"{schema}, `{out}` array<double>")


def synthesize(df: DataFrame, coefficients: str = "latent", out: str = "relief") -> DataFrame:
    """The relief on the sphere's grid that coefficients stand for."""
    return _product(df, coefficients, out, sphere()[0].T)


def analyze(df: DataFrame, relief: str = "relief", out: str = "latent") -> DataFrame:
    """The coefficients of a relief."""
    basis, weights = sphere()
    return _product(df, relief, out, basis * weights)


def _wave(shape: tuple[int, int]) -> np.ndarray:
    """Wave numbers of a periodic grid as complex numbers, x real and y imaginary."""
    y, x = (2 * np.pi * np.fft.fftfreq(n) for n in shape)
    return x[None, :] + 1j * y[:, None]


def div_curl(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divergence and curl of a periodic field."""
    k, fu, fv = _wave(u.shape), np.fft.fft2(u), np.fft.fft2(v)
    back = lambda f: np.fft.ifft2(1j * f).real
    return back(k.real * fu + k.imag * fv), back(k.real * fv - k.imag * fu)


def field_of(div: np.ndarray, curl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The field without mean that has a divergence and a curl (without means, and without the unpaired wave of even grids)."""
    k = _wave(div.shape)
    size = np.where(np.abs(k) == 0, 1.0, np.abs(k) ** 2)
    fd, fc = np.fft.fft2(div) / size, np.fft.fft2(curl) / size
    u = np.fft.ifft2(-1j * (k.real * fd - k.imag * fc)).real
    v = np.fft.ifft2(-1j * (k.imag * fd + k.real * fc)).real
    return u, v


def hodge(u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient part and the rotating part of a periodic field; with its mean they add up to it."""
    d, c = div_curl(u, v)
    zero = np.zeros_like(d)
    gu, gv = field_of(d, zero)
    return {"u_gradient": gu, "v_gradient": gv, "u_rotation": u - u.mean() - gu, "v_rotation": v - v.mean() - gv, "div": d, "curl": c}


def hodge_frames(fields: DataFrame, rows: int, columns: int) -> DataFrame:
    """``hodge`` of every row (id, u, v) of flat arrays on one grid."""
    names = ["u_gradient", "v_gradient", "u_rotation", "v_rotation", "div", "curl"]

    def run(it):
        import pandas as pd

        for pdf in it:
            made = [hodge(*(np.asarray(x, float).reshape(rows, columns) for x in (u, v))) for u, v in zip(pdf["u"], pdf["v"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], **{n: [m[n].ravel() for m in made] for n in names}})

    return fields.select(F.col("id").cast("long").alias("id"), "u", "v").mapInPandas(run, "id long, " + ", ".join(f"{n} array<double>" for n in names))


def streaks(u: np.ndarray, v: np.ndarray, noise: np.ndarray, steps: int = 12, step: float = 0.5) -> np.ndarray:
    """Noise averaged along the field's streamlines, both ways, on a periodic grid."""
    shape = np.array(noise.shape)
    speed = np.hypot(u, v) + 1e-9
    along = np.stack([v / speed, u / speed])
    here = np.stack(np.meshgrid(*map(np.arange, noise.shape), indexing="ij")).astype(float)

    def at(fields: np.ndarray, p: np.ndarray) -> np.ndarray:
        low = np.floor(p).astype(int)
        part = p - low
        total = 0.0
        for corner in ((0, 0), (0, 1), (1, 0), (1, 1)):
            i, j = ((low[a] + corner[a]) % shape[a] for a in (0, 1))
            weight = np.prod([part[a] if corner[a] else 1 - part[a] for a in (0, 1)], axis=0)
            total = total + fields[..., i, j] * weight
        return total

    out = noise.astype(float).copy()
    for sign in (1.0, -1.0):
        p = here.copy()
        for _ in range(steps):
            p = np.mod(p + sign * step * at(along, p), shape[:, None, None])
            out += at(noise, p)
    return out / (2 * steps + 1)
