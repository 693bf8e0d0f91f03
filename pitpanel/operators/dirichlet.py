"""One concentration of a Dirichlet-multinomial for many groups of counts, against the multinomial."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of numbers above 0: shifted past 10, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    small = x < 10
    y = x.copy()
    while small.any():
        shift[small] += np.log(y[small])
        y[small] += 1
        small = y < 10
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def fit_concentration(df: DataFrame, counts: Sequence[str], *, low: float = 0.1, high: float = 10_000.0, steps: int = 16, rounds: int = 3) -> DataFrame:
    """One row: concentration, nll, nll_multinomial, gain: the concentration of least negative log likelihood on a grid.

    Every round of the grid (geometric, `steps` values, the next between the best one's neighbours) sums over cells of equal
    counts, so groups with the same counts are computed once. Mean shares are those of all counts together, 1e-9 at least. The
    likelihoods leave out the multinomial coefficient, which both have. gain: nll_multinomial - nll. A null count is 0; without counts there is no row.
    """
    cells = df.select(*[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"c{i}") for i, c in enumerate(counts)])
    cells = cells.groupBy(*cells.columns).agg(F.count("*").alias("m"))
    d = len(counts)
    total = cells.agg(*[F.sum(F.col(f"c{i}") * F.col("m")) for i in range(d)]).first()
    if not any(total):
        return df.sparkSession.createDataFrame([], "concentration double, nll double, nll_multinomial double, gain double")
    share = np.maximum(np.array(total, dtype=float) / sum(total), 1e-9)
    plain = -float((np.array(total) * np.log(share)).sum())

    @F.pandas_udf("double")
    def loss(c: pd.DataFrame, k: pd.Series) -> pd.Series:
        x, kappa = c.to_numpy(float), k.to_numpy(float)
        a = kappa[:, None] * share
        out = log_gamma(kappa) - log_gamma(kappa + x.sum(axis=1)) + (log_gamma(a + x) - log_gamma(a)).sum(axis=1)
        return pd.Series(-out)

    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
        long = cells.withColumn("k", F.explode(F.array(*map(F.lit, grid))))
        by = long.withColumn("l", loss(F.struct(*[f"c{i}" for i in range(d)]), "k") * F.col("m")).groupBy("k").agg(F.sum("l").alias("l"))
        found = {r.k: r.l for r in by.collect()}  # a row for each value of the grid
        best = min(range(steps), key=lambda i: (round(found[grid[i]], 9), -grid[i]))
        value = (grid[best], found[grid[best]])
        low, high = grid[max(0, best - 1)], grid[min(steps - 1, best + 1)]
    return df.sparkSession.createDataFrame([(value[0], value[1], plain, plain - value[1])], "concentration double, nll double, nll_multinomial double, gain double")
