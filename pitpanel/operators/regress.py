"""Walk-forward regression: every epoch is scored by coefficients from strictly earlier epochs only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _moments(features: Sequence[str], target: str) -> dict[str, Column]:
    """Sums for the normal equations; of a pair of features over rows that have both."""
    x, out = [F.col(c) for c in features], {"n": F.count("*"), "y": F.sum(target)}
    for i, a in enumerate(x):
        has = a.isNotNull()
        out |= {f"c{i}": F.count(a), f"y{i}": F.sum(F.when(has, F.col(target)))}
        for j, b in enumerate(x):
            both = has & b.isNotNull()
            out[f"s{i}_{j}"] = F.sum(F.when(b.isNotNull(), a))  # of feature i where j is there
            if j <= i:
                out |= {f"n{i}_{j}": F.count_if(both), f"p{i}_{j}": F.sum(a * b)}
        out[f"q{i}"] = F.sum(a * F.col(target))
    return out


def solve_ridge(m: pd.DataFrame, k: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, [intercept, slopes]) for each row of sums: a ridge on standardised features.

    A feature that is missing in a row stands at its mean; one without values or without spread has no slope's effect.
    """
    n, y = m["n"].to_numpy(float), m["y"].to_numpy(float)
    col = lambda c: m[c].to_numpy(float)
    count = np.stack([col(f"c{i}") for i in range(k)], 1)
    mean = np.nan_to_num(np.stack([col(f"s{i}_{i}") for i in range(k)], 1)) / np.maximum(count, 1)
    cov, cross = np.zeros((len(m), k, k)), np.zeros((len(m), k))
    for i in range(k):
        cross[:, i] = np.nan_to_num(col(f"q{i}") - mean[:, i] * col(f"y{i}"))
        for j in range(i + 1):
            s = col(f"p{i}_{j}") - mean[:, i] * col(f"s{j}_{i}") - mean[:, j] * col(f"s{i}_{j}") + col(f"n{i}_{j}") * mean[:, i] * mean[:, j]
            cov[:, i, j] = cov[:, j, i] = np.nan_to_num(s)
    var = np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0) / n[:, None]
    dev = np.sqrt(np.where(var > 1e-18 * (1 + mean**2), var, 1.0))
    spread = np.where(var > 1e-18 * (1 + mean**2), 1.0, 0.0)
    a = cov / (dev[:, :, None] * dev[:, None, :]) * (spread[:, :, None] * spread[:, None, :]) + alpha * np.eye(k)
    slopes = np.linalg.solve(a, (cross / dev * spread)[:, :, None])[:, :, 0]
    return mean, dev, np.concatenate(((y / n)[:, None], slopes), 1)


def walk_forward_ridge(
    df: DataFrame,
    group: Sequence[str],
    epoch: str,
    features: Sequence[str],
    target: str,
    *,
    alpha: float = 5.0,
    min_rows: int = 20,
    min_epochs: int = 4,
    watch: float = -1.5,
) -> DataFrame:
    """df with predicted, residual (target less predicted), residual_z and watchlist (residual_z <= watch).

    Per group and epoch a ridge of target on standardised features, intercept free, over the group's rows of
    strictly earlier epochs. Rows of the first `min_epochs` epochs of the whole table, of groups with under min_rows
    earlier rows, and rows without target are left out. residual_z divides by the deviation (over all rows, not n - 1) of the
    group's residuals in that epoch; it is 0 where they have none. A missing feature stands at the mean of the training rows.

    One aggregate gives the sums by group and epoch; running sums over epochs and the solving work on that small
    table, which has a row for each group and epoch. No row is repeated for the epochs that it trains.
    """
    k, keys = len(features), [*group, epoch]
    rows = df.where(F.col(target).isNotNull())
    as_double = rows.withColumns({f"_x{i}": F.col(c).cast("double") for i, c in enumerate(features)} | {"_y": F.col(target).cast("double")})
    names = [f"_x{i}" for i in range(k)]
    moments = _moments(names, "_y")
    sums = as_double.groupBy(*keys).agg(*[c.alias(m) for m, c in moments.items()])
    # every group has every later epoch, if it has rows there or not: sums run over the epochs there are
    before = Window.partitionBy(*group).orderBy(epoch).rangeBetween(Window.unboundedPreceding, -1)
    past = sums.select(*keys, *[F.sum(m).over(before).alias(m) for m in moments]).where(F.col("n") >= min_rows)
    epochs = rows.select(epoch).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(epoch)  # calendar epochs, not rows
    late = epochs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") > min_epochs).select(epoch)
    past = past.join(F.broadcast(late), epoch)
    kinds = ", ".join([*(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in keys), *(f"{p}{i} double" for p in ("_m", "_d", "_b") for i in range(k)), "_b double"])

    def solve(batches):
        for m in batches:
            mean, dev, beta = solve_ridge(m, k, alpha)
            out = m[keys].copy()
            for i in range(k):
                out[f"_m{i}"], out[f"_d{i}"], out[f"_b{i}"] = mean[:, i], dev[:, i], beta[:, i + 1]
            out["_b"] = beta[:, 0]
            yield out[[*keys, *(f"{p}{i}" for p in ("_m", "_d", "_b") for i in range(k)), "_b"]]

    model = past.mapInPandas(solve, kinds)
    scored = as_double.join(model, keys)
    fit = F.col("_b")
    for i in range(k):
        fit = fit + F.coalesce((F.col(f"_x{i}") - F.col(f"_m{i}")) / F.col(f"_d{i}"), F.lit(0.0)) * F.col(f"_b{i}")
    scored = scored.withColumns({"predicted": fit}).withColumn("residual", F.col("_y") - F.col("predicted"))
    spread = scored.groupBy(*keys).agg(F.stddev_pop("residual").alias("_sd"))
    z = F.when(F.col("_sd") > 0, F.col("residual") / F.col("_sd")).otherwise(0.0)
    out = scored.join(spread, keys).withColumn("residual_z", z).withColumn("watchlist", F.col("residual_z") <= watch)
    return out.select(*df.columns, "predicted", "residual", "residual_z", "watchlist")
