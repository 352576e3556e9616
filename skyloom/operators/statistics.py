"""Robust outliers, dispersion, correlation, periods, ridge attribution and circular means."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def quantiles(df: DataFrame, asked: dict[str, tuple[Column, list[float]]], few: int = 100_000, bins: int = 4096) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between neighbours) of several columns by repeated histograms: no task sorts a column or gathers it.

    asked: name -> (column, shares). Each pass over the data counts ``bins`` equal ranges
    of every interval that still holds more than ``few`` values, for all columns and
    ranks at once, and keeps the ranges that hold a rank; a last pass counts the distinct
    values of what is left. Order: -Infinity, numbers, Infinity, NaN; nulls do not count.
    """
    x = df.select(*[c.cast("double").alias(name) for name, (c, _) in asked.items()])
    endless = float("inf")
    finite = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) != endless)
    stats = x.agg(
        *[F.count(n).alias(f"n_{n}") for n in asked],
        *[F.count_if(F.col(n) == -endless).alias(f"low_{n}") for n in asked],
        *[F.count_if(F.col(n) == endless).alias(f"high_{n}") for n in asked],
        *[F.count_if(finite(n)).alias(f"some_{n}") for n in asked],
        *[F.min(F.when(finite(n), F.col(n))).alias(f"a_{n}") for n in asked],
        *[F.max(F.when(finite(n), F.col(n))).alias(f"b_{n}") for n in asked],
    ).first()
    found: dict[tuple[str, int], float] = {}
    #: (name, least, greatest, values below, values within) -> ranks
    spans: dict[tuple[str, float, float, int, int], list[int]] = {}
    for name, (_, shares) in asked.items():
        n, low, some = stats[f"n_{name}"], stats[f"low_{name}"], stats[f"some_{name}"]
        for k in sorted({y for q in shares if n for y in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))}):
            if low <= k < low + some:
                spans.setdefault((name, stats[f"a_{name}"], stats[f"b_{name}"], low, some), []).append(k)
            else:
                found[name, k] = -endless if k < low else endless if k < low + some + stats[f"high_{name}"] else float("nan")

    def each(own: list[tuple], value) -> DataFrame:
        """One row for each interval that a row's values lie in: its number, value(interval, x) and x."""
        cells = [F.when(F.col(s[0]).between(s[1], s[2]), F.struct(F.lit(i).alias("i"), value(s, F.col(s[0])).alias("p"), F.col(s[0]).alias("x"))) for i, s in enumerate(own)]
        return x.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")

    while spans:
        for s in [s for s in spans if s[1] == s[2]]:
            found |= {(s[0], k): s[1] for k in spans.pop(s)}
        width = lambda s: s[2] / bins - s[1] / bins
        wide = [s for s in spans if s[4] > few and s[1] + width(s) != s[1]]
        if wide:
            place = lambda s, v: F.least(F.greatest(F.floor(v / F.lit(width(s)) - F.lit(s[1] / width(s))), F.lit(0)), F.lit(bins - 1))
            rows = each(wide, place).groupBy("i", "p").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        elif spans:
            rows = each(list(spans), lambda s, v: v).groupBy("i", "p").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        own = wide or list(spans)
        for i, s in enumerate(own):
            ranks, below = spans.pop(s), s[3]
            for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["a"]):
                inside = [k for k in ranks if below <= k < below + r["n"]]
                if inside:
                    spans[s[0], r["a"], r["b"], below, r["n"]] = inside
                below += r["n"]
    out: dict[str, list[float | None]] = {}
    for name, (_, shares) in asked.items():
        n = stats[f"n_{name}"]
        out[name] = []
        for q in shares:
            at = q * (n - 1)
            low, high = (found[name, int(at)], found[name, min(int(at) + 1, n - 1)]) if n else (None, None)
            out[name].append(low if not n or low == high or at == int(at) else low + (at - int(at)) * (high - low))
    return out


def quantile(df: DataFrame, value: Column, q: float, few: int = 100_000, bins: int = 4096) -> float | None:
    """One exact quantile of one column."""
    return quantiles(df, {"x": (value, [q])}, few, bins)["x"][0]


def robust_thresholds(df: DataFrame, values: list[str], sigma: float) -> list[float | None]:
    """median + sigma * 1.4826 * MAD of each column: one search for the medians, one for the deviations."""
    middles = quantiles(df, {f"x{i}": (F.col(v), [0.5]) for i, v in enumerate(values)})
    middles = [middles[f"x{i}"][0] for i in range(len(values))]
    spreads = quantiles(df, {f"x{i}": (F.abs(F.col(v) - F.lit(middles[i])), [0.5]) for i, v in enumerate(values) if middles[i] is not None}) if any(m is not None for m in middles) else {}
    return [None if m is None else m + sigma * MAD_SCALE * spreads[f"x{i}"][0] for i, m in enumerate(middles)]


def robust_threshold(df: DataFrame, value: str, sigma: float) -> DataFrame:
    """One row: the robust threshold of a column."""
    return df.sparkSession.createDataFrame([tuple(robust_thresholds(df, [value], sigma))], "threshold double")


def zscore(value: str) -> Column:
    """Over all rows, population deviation, 1 where that is 0. Meant for the few rows that passed a threshold."""
    everything = Window.partitionBy()
    sd = F.stddev_pop(value).over(everything)
    return (F.col(value) - F.avg(value).over(everything)) / F.when(sd == 0, 1.0).otherwise(sd)


def singularities(df: DataFrame, potential: str, shear: str, sigma: float, limit: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows beyond both robust thresholds, by the sum of their z-scores over all rows."""
    bounds = df.sparkSession.createDataFrame([tuple(robust_thresholds(df, [potential, shear], sigma))], "_tp double, _ts double")
    stats = df.agg(
        *[f(c).alias(f"_{n}{i}") for i, c in enumerate((potential, shear)) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    )
    wide = df.crossJoin(F.broadcast(bounds.crossJoin(stats)))
    z = lambda c, i: (F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_d{i}") == 0, 1.0).otherwise(F.col(f"_d{i}"))
    found = wide.where((F.col(potential) > F.col("_tp")) & (F.col(shear) > F.col("_ts"))).withColumn("score", z(potential, 0) + z(shear, 1))
    found = found.select(*df.columns, "score").orderBy(F.desc("score"), *ties)
    return found.limit(limit) if limit else found


def completed(counts: DataFrame, rows: DataFrame, columns: DataFrame, value: str) -> DataFrame:
    """Every pair of the two key lists, absent ones 0. Both lists are distinct keys, the columns' few enough to broadcast."""
    grid = rows.crossJoin(F.broadcast(columns))
    return grid.join(counts, [*rows.columns, *columns.columns], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def fano(binned: DataFrame, token: str, value: str) -> DataFrame:
    """Population variance over mean of each token's bins; 0 for a mean of 0."""
    mean = F.avg(value)
    return binned.groupBy(token).agg(F.when(mean == 0, 0.0).otherwise(F.var_pop(value) / F.nullif(mean, F.lit(0.0))).alias("fano"))


def correlations(dense: DataFrame, day: str, token: str, value: str, least_days: int = 3) -> DataFrame:
    """Population Pearson correlation of all token pairs a < b by common days.

    Constant tokens have none. The tokens' series meet on the day, and pairs are
    aggregated before anything leaves the task.
    """
    stats = dense.groupBy(token).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n_days")).where((F.col("sd") > 1e-9) & (F.col("n_days") >= least_days))
    centred = dense.join(stats, token).select(day, token, ((F.col(value) - F.col("m")) / F.col("sd")).alias("z"), "n_days")
    a = centred.select(day, F.col(token).alias("a"), F.col("z").alias("za"), "n_days")
    b = centred.select(day, F.col(token).alias("b"), F.col("z").alias("zb"))
    return a.join(b, day).where("a < b").groupBy("a", "b").agg((F.sum(F.col("za") * F.col("zb")) / F.max("n_days")).alias("corr"))


def dominant_period(daily: DataFrame, token: str, day: str, value: str, least: int = 16) -> DataFrame:
    """The strongest period in days of each token's series and its share of power; gaps count as 0. One series is one group."""
    def run(pdf):
        import pandas as pd

        name, first, n = pdf["token"].iloc[0], int(pdf["first"].iloc[0]), int(pdf["n_days"].iloc[0])
        dense = np.zeros(n)
        np.add.at(dense, pdf["day"].to_numpy(np.int64) - first, pdf["value"].to_numpy(float))
        power = np.abs(np.fft.rfft(dense - dense.mean())) ** 2
        power[0] = 0.0
        if n < least or not (power > 0).any():
            return pd.DataFrame({"token": [], "period_days": [], "power_fraction": []}).astype({"token": pdf["token"].dtype, "period_days": float, "power_fraction": float})
        k = int(power.argmax())
        return pd.DataFrame({"token": [name], "period_days": [n / k], "power_fraction": [power[k] / (power.sum() + 1e-12)]})

    series = daily.groupBy(F.col(token).alias("token"), F.col(day).cast("long").alias("day")).agg(F.sum(value).cast("double").alias("value"))
    bounds = series.agg(F.min("day").alias("first"), (F.max("day") - F.min("day") + 1).alias("n_days"))
    kind = daily.schema[token].dataType.simpleString()
    out = series.crossJoin(F.broadcast(bounds)).groupBy("token").applyInPandas(run, f"token {kind}, period_days double, power_fraction double")
    return out.withColumnRenamed("token", token)


def moments(df: DataFrame, features: list[str], target: str, by: list[str] | None = None) -> DataFrame:
    """Counts and sums of products, enough for least squares; partial sums add up."""
    cols = [*features, target]
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *sums, *products)


def ridge(row, k: int, strength: float = 1e-3) -> list[float]:
    """Coefficients from a row of ``moments``: penalty strength * (trace / k + 1e-9)."""
    n = row["n"]
    s = np.array([row[f"s_{i}"] for i in range(k + 1)], float)
    p = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            p[i, j] = p[j, i] = row[f"p_{i}_{j}"]
    c = p / n - np.outer(s, s) / (n * n)
    x = c[:k, :k]
    return np.linalg.solve(x + strength * (np.trace(x) / k + 1e-9) * np.eye(k), c[:k, k]).tolist()


def attribution(coefficients: list[float], groups: list[str]) -> dict[str, float]:
    """Shares of the absolute coefficients by group."""
    total = sum(map(abs, coefficients)) or 1.0
    out: dict[str, float] = {}
    for c, g in zip(coefficients, groups, strict=True):
        out[g] = out.get(g, 0.0) + abs(c) / total
    return out


def circular_mean(df: DataFrame, by: list[str], angle: Column, weight: Column | None = None) -> DataFrame:
    """Concentration R and mean angle of weighted unit vectors (radians)."""
    w = F.lit(1.0) if weight is None else weight
    sums = df.groupBy(*by).agg(F.sum(w * F.cos(angle)).alias("_c"), F.sum(w * F.sin(angle)).alias("_s"), F.sum(w).alias("_w"))
    r = F.when(F.col("_w") == 0, 0.0).otherwise(F.hypot("_c", "_s") / F.nullif(F.col("_w"), F.lit(0.0)))
    return sums.select(*by, r.alias("concentration"), F.pmod(F.atan2("_s", "_c"), F.lit(2 * math.pi)).alias("mean_angle"))


def column_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, corr) for each column against the target; constant columns have none."""
    spread = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("f"), F.col(target).cast("double").alias("y")).select("f.*", "y")
    g = spread.groupBy("feature").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return g.where((F.col("sx") > 1e-9) & (F.col("sy") > 1e-9)).select("feature", (F.col("c") / (F.col("sx") * F.col("sy"))).alias("corr"))


def strongest(corrs: DataFrame) -> DataFrame:
    return corrs.agg(F.max_by("feature", F.struct(F.abs("corr"), F.col("feature"))).alias("feature"), F.max_by("corr", F.struct(F.abs("corr"), F.col("feature"))).alias("corr"))


