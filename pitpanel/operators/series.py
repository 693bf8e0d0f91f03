"""Sequential algorithms on one entity's series at a time, in Arrow batches per group; series are short by nature."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Series up to this length are told together, longer ones one by one.
SHORT = 200


def cusum(x: Sequence[float], k: float, h: float) -> list[bool]:
    """Page's cumulative sums of the standardised series, one for either direction, both from 0 after a flag.

    Series under three values and constant ones have no flags.
    """
    a = np.asarray(x, dtype=float)
    if len(a) < 3 or not a.std() > 0:
        return [False] * len(a)
    out, sums = [], np.zeros(2)
    for z in (a - a.mean()) / a.std():
        sums = np.maximum(0.0, sums + (z, -z) - np.array(k))
        out.append(bool(sums.max() > h))
        if out[-1]:
            sums[:] = 0.0
    return out


def _log_t(x: float, df: np.ndarray, mean: np.ndarray, scale2: np.ndarray) -> np.ndarray:
    """Log density of Student's t."""
    gamma = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in df])
    return gamma - 0.5 * np.log(df * math.pi * scale2) - (df + 1) / 2 * np.log1p((x - mean) ** 2 / (df * scale2))


def changepoint_probability(x: Sequence[float], hazard: float = 1 / 25, recent: int = 2, prune: float = 1e-8) -> list[float]:
    """For each value, the probability that the series changed within the last `recent` values, by its past alone.

    The run-length recursion for Gaussian data of unknown mean and variance: of every run that may be current, its
    weight, count, mean and sum of squares are kept. The prior of a run's mean lies around the mean of all values
    so far with as much spread as they have, worth a quarter of a value. Runs under `prune` of the weight are
    dropped. Of the first 2 * recent + 1 values nothing can be told: they get 0.
    """
    a = np.asarray(x, dtype=float)
    log_w, n, mean, ss = np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1)
    out: list[float] = []
    for t, v in enumerate(a):
        past = a[: t + 1]
        centre, spread = past.mean(), max(float(past.var()), 1e-9 * (1 + float(np.abs(past).max())) ** 2)
        k = n + 0.25  # the prior's mean has a quarter of a value's weight, its variance that of four values
        mu = (0.25 * centre + n * mean) / k
        beta = spread + 0.5 * (ss + 0.25 * n * (mean - centre) ** 2 / k)
        alpha = 2 + n / 2
        seen = log_w + _log_t(v, 2 * alpha, mu, beta * (k + 1) / (alpha * k))
        top = seen.max()
        fresh = top + math.log(np.exp(seen - top).sum()) + math.log(hazard)
        log_w = np.concatenate(([fresh], seen + math.log1p(-hazard)))
        log_w -= log_w.max() + math.log(np.exp(log_w - log_w.max()).sum())
        step = (v - mean) / (n + 1)
        n, mean, ss = (np.concatenate(([0.0], y)) for y in (n + 1, mean + step, ss + step * (v - mean) * n))
        held = log_w > math.log(prune)
        log_w, n, mean, ss = log_w[held], n[held], mean[held], ss[held]
        out.append(float(np.exp(log_w[n <= recent]).sum()) if t > 2 * recent else 0.0)
    return out


def changepoint_probabilities(series: Sequence[np.ndarray], hazard: float = 1 / 25, recent: int = 2, prune: float = 1e-8) -> list[np.ndarray]:
    """changepoint_probability of many series of like length at once: a row for each series, a column for each run.

    Column j after value t holds the run of j values, so a run's count is its column; pruned runs weigh nothing. Series have to be
    without gaps; shorter ones go on with their last value, and what comes of that is cut off.
    """
    sizes = np.array([len(x) for x in series])
    longest = int(sizes.max(initial=0))
    if not longest:
        return [np.zeros(0) for _ in series]
    a = np.array([np.concatenate((x, np.full(longest - len(x), x[-1] if len(x) else 0.0))) for x in series], dtype=float)
    log_w, mean, ss = (np.zeros((len(a), 1)) for _ in range(3))
    out = np.zeros(a.shape)
    count = np.arange(longest + 1.0)
    # log density of Student's t with 2 alpha degrees of freedom: what depends on the count alone
    gamma = np.array([math.lgamma((4 + n + 1) / 2) - math.lgamma((4 + n) / 2) for n in count])
    for t in range(longest):
        v, past, n = a[:, t : t + 1], a[:, : t + 1], count[: t + 1]
        centre = past.mean(axis=1, keepdims=True)
        spread = np.maximum(past.var(axis=1, keepdims=True), 1e-9 * (1 + np.abs(past).max(axis=1, keepdims=True)) ** 2)
        k, alpha = n + 0.25, 2 + n / 2
        mu = (0.25 * centre + n * mean) / k
        beta = spread + 0.5 * (ss + 0.25 * n * (mean - centre) ** 2 / k)
        scale2, df = beta * (k + 1) / (alpha * k), 2 * alpha
        seen = log_w + gamma[: t + 1] - 0.5 * np.log(df * math.pi * scale2) - (df + 1) / 2 * np.log1p((v - mu) ** 2 / (df * scale2))
        top = seen.max(axis=1, keepdims=True)
        fresh = top + np.log(np.exp(seen - top).sum(axis=1, keepdims=True)) + math.log(hazard)
        log_w = np.concatenate((fresh, seen + math.log1p(-hazard)), axis=1)
        most = log_w.max(axis=1, keepdims=True)
        log_w -= most + np.log(np.exp(log_w - most).sum(axis=1, keepdims=True))
        step = (v - mean) / (n + 1)
        ss = np.concatenate((np.zeros_like(v), ss + step * (v - mean) * n), axis=1)
        mean = np.concatenate((np.zeros_like(v), mean + step), axis=1)
        log_w[log_w <= math.log(prune)] = -np.inf
        if t > 2 * recent:
            out[:, t] = np.exp(log_w[:, : recent + 1]).sum(axis=1)
    return [row[:n] for row, n in zip(out, sizes, strict=True)]


def panel(df: DataFrame, keys: Sequence[str], order: str, value: str, *, k: float = 0.5, h: float = 4.0, hazard: float = 1 / 25, least: int = 4) -> DataFrame:
    """(keys, order, p_change, cusum_flag, since_change) of every row of groups with at least `least` values."""

    sample = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("x"))))
    s = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(sample.alias("_s")).where(F.size("_s") >= least)

    @F.pandas_udf("array<struct<p:double,f:boolean,n:bigint>>")
    def told(xs: pd.Series) -> pd.Series:
        p = [np.zeros(0)] * len(xs)
        sizes = xs.map(len)
        short = sizes[sizes <= SHORT].sort_values().index.to_numpy()
        for at in np.array_split(short, range(512, len(short), 512)):  # like lengths together
            for i, found in zip(at, changepoint_probabilities([xs[i] for i in at], hazard), strict=True):
                p[i] = found
        for i in sizes[sizes > SHORT].index:  # runs are pruned, so a long series costs less one by one
            p[i] = changepoint_probability(xs[i], hazard)
        out = []
        for x, q in zip(xs, p, strict=True):
            since, n = [], 0
            for i, chance in enumerate(q):
                n = 0 if i and chance > 0.5 else n + 1
                since.append(n)
            out.append([{"p": float(c), "f": f, "n": m} for c, f, m in zip(q, cusum(x, k, h), since, strict=True)])
        return pd.Series(out)

    out = s.select(*keys, "_s", told(F.col("_s.x")).alias("_f")).select(*keys, F.explode(F.arrays_zip("_s", "_f")).alias("_z"))
    z = F.col("_z._f")
    return out.select(*keys, F.col("_z._s.at").alias(order), z["p"].alias("p_change"), z["f"].alias("cusum_flag"), z["n"].alias("since_change"))


def cusum_panel(df: DataFrame, keys: Sequence[str], order: str, value: str, *, k: float = 0.5, h: float = 4.0, least: int = 4) -> DataFrame:
    """(keys, order, cusum_flag) as panel has it, without change probabilities; a series is an array, many of them a batch."""
    sample = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("x"))))
    s = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(sample.alias("_s")).where(F.size("_s") >= least)

    @F.pandas_udf("array<boolean>")
    def flags(xs: pd.Series) -> pd.Series:
        return pd.Series([cusum(x, k, h) for x in xs])

    out = s.select(*keys, "_s", flags(F.col("_s.x")).alias("_f")).select(*keys, F.explode(F.arrays_zip("_s", "_f")).alias("_z"))
    return out.select(*keys, F.col("_z._s.at").alias(order), F.col("_z._f").alias("cusum_flag"))


def normal_crps(y: float, mean: float, sd: float) -> float:
    """Closed-form CRPS of a normal forecast."""
    z = (y - mean) / sd
    cdf = 0.5 * math.erfc(-z / math.sqrt(2))
    return sd * (z * (2 * cdf - 1) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def two_sided_p(t: Column, df: Column, steps: int = 400) -> Column:
    """Two-sided p of Student's t, by midpoints: with x = sqrt(df) tan(a) its density is in proportion to cos(a) ^ (df - 1)."""

    @F.pandas_udf("double")
    def told(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        mid = (np.arange(steps) + 0.5) / steps
        whole, out = np.log(np.cos(math.pi / 2 * mid)), np.full(len(ts), np.nan)
        some = np.flatnonzero(ts.notna() & dfs.notna())
        for at in np.array_split(some, range(256, len(some), 256)):
            d = dfs.to_numpy(dtype=float)[at][:, None]
            w = np.arctan(np.abs(ts.to_numpy(dtype=float)[at][:, None]) / np.sqrt(d))
            part = np.exp((d - 1) * np.log(np.cos(w * mid))).sum(axis=1) * w[:, 0]
            out[at] = 1 - part / (np.exp((d - 1) * whole).sum(axis=1) * (math.pi / 2))
        return pd.Series(out)

    return told(t, df)
