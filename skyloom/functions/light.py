"""Flux, colour temperature and colour spaces, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.angles import clamp
from skyloom.functions.calendar import col

# Temperature range, OKLab matrices, and the Planckian locus's cubics in 1000 K / T.
T_COMMON, T_RARE = 1200.0, 40000.0
LAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
LOCUS_X = {4000.0: (-0.2661239, -0.2343589, 0.8776956, 0.179910), None: (-3.0258469, 2.1070379, 0.2226347, 0.240390)}
LOCUS_Y = {
    2222.0: (-1.1063814, -1.34811020, 2.18555832, -0.20219683),
    4000.0: (-0.9549476, -1.37418593, 2.09137015, -0.16748867),
    None: (3.0817580, -5.87338670, 3.75112997, -0.37001483),
}


def naka_rushton(x, k: float = 1.0, n: float = 1.0) -> Column:
    p = F.pow(F.greatest(col(x).cast("double"), F.lit(0.0)), F.lit(n))
    return p / (p + k**n)


def naka_rushton_inverse(flux, k: float = 1.0, n: float = 1.0) -> Column:
    f = clamp(col(flux), 0.0, 1.0 - 1e-12)
    return k * F.pow(f / (1 - f), F.lit(1.0 / n))


def rarity_to_temperature(rarity) -> Column:
    return T_COMMON * F.pow(F.lit(T_RARE / T_COMMON), clamp(col(rarity), 0.0, 1.0))


def temperature_to_rarity(kelvin) -> Column:
    return F.ln(col(kelvin) / T_COMMON) / math.log(T_RARE / T_COMMON)


def _cubic(table: dict, t: Column, u: Column) -> Column:
    value = lambda c: ((c[0] * u + c[1]) * u + c[2]) * u + c[3]
    out = value(table[None])
    for limit in sorted((x for x in table if x), reverse=True):
        out = F.when(t <= limit, value(table[limit])).otherwise(out)
    return out


def planckian_xy(kelvin) -> Column:
    """struct(x, y) of the Planckian locus."""
    t = clamp(col(kelvin), 1000.0, 25000.0)
    x = _cubic(LOCUS_X, t, 1000.0 / t)
    return F.struct(x.alias("x"), _cubic(LOCUS_Y, t, x).alias("y"))


def correlated_temperature(x, y) -> Column:
    """McCamy's cubic."""
    n = (col(x) - 0.3320) / (0.1858 - col(y))
    return ((449.0 * n + 3525.0) * n + 6823.3) * n + 5520.33


def blackbody(wavelength_nm, kelvin) -> Column:
    h, c, k = 6.62607015e-34, 2.99792458e8, 1.380649e-23
    m = col(wavelength_nm) * 1e-9
    return (2 * h * c * c) / (F.pow(m, F.lit(5.0)) * (F.exp(h * c / (m * k * col(kelvin))) - 1.0))


def _times(matrix, v: list[Column]) -> list[Column]:
    return [sum(m * x for m, x in zip(row[1:], v[1:], strict=True)) + row[0] * v[0] for row in matrix]


def oklab_to_linear(lab: Column) -> Column:
    lms = [x * x * x for x in _times(LAB_TO_LMS, [lab[0], lab[1], lab[2]])]
    return F.array(*_times(LMS_TO_RGB, lms))


def oklab_to_srgb(lab: Column) -> Column:
    def encode(x: Column) -> Column:
        x = clamp(x, 0.0, 1.0)
        return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)

    return F.transform(oklab_to_linear(lab), encode)


def oklab_to_srgb8(lab: Column) -> Column:
    """Halves round to even."""
    return F.transform(oklab_to_srgb(lab), lambda x: F.rint(x * 255).cast("int"))
