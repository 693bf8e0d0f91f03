"""Monitoring, calibration and evaluation as aggregates over predictions and outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.operators.ranks import quantiles


def psi(base: DataFrame, live: DataFrame, x: str, bins: int, save, floor: float = 1e-6) -> DataFrame:
    """Population stability index on quantile bins of the base."""
    at = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = quantiles(base, [], x, at, save).select(F.array(*at).alias("cuts"))  # one row
    place = F.size(F.filter("cuts", lambda c: c < F.col(x)))
    count = lambda df, n: df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(cuts)).groupBy(place.alias("bin")).agg(F.count("*").alias(n))
    both = count(base, "b").join(count(live, "v"), "bin", "full").na.fill(0)
    share = both.agg(F.sum("b").alias("tb"), F.sum("v").alias("tv"))
    both = both.crossJoin(F.broadcast(share))
    p, q = F.greatest(F.col("b") / F.col("tb"), F.lit(floor)), F.greatest(F.col("v") / F.col("tv"), F.lit(floor))
    return both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def pinball(y: Column, pred: Column, quantile: float) -> Column:
    d = y - pred
    return F.greatest(quantile * d, float(Decimal(str(quantile)) - 1) * d)


def sample_quantile(values: Column, q: float) -> Column:
    """The quantile of a sorted array without nulls, low * (1 - part) + high * part, the first product not rounded.

    Where an actual value equals a quantile, its last bit decides which is larger, so the product is taken in two parts.
    """
    place = (F.size(values) - 1).cast("double") * F.lit(q)
    low, high = (F.get(values, f(place).cast("int")) for f in (F.floor, F.ceil))
    part = place - F.floor(place)
    rest, added = 1 - part, high * part
    top = rest * float(2**27 + 1) - (rest * float(2**27 + 1) - rest)
    first = low * rest
    lost = (low * top - first) + low * (rest - top)
    total = first + added
    back = total - first
    return total + (((first - (total - back)) + (added - back)) + lost)


def rounded(x: Column, digits: int) -> Column:
    """x times a power of ten, to a whole number, halves away from 0: a value midway in decimals goes where its product lies."""
    return F.round(x * 10.0**digits) / 10.0**digits


def strata(df: DataFrame, dims: Mapping[str, Column], aggs: Sequence[Column]) -> DataFrame:
    """The aggregates over several stratifications in one pass: a row per (dimension, label)."""
    rows = [F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("label")) for k, c in dims.items()]
    return df.select("*", F.inline(F.array(*rows))).groupBy("dimension", "label").agg(*aggs)


def sample_crps(df: DataFrame, keys: Sequence[str], sample: str, actual: str) -> DataFrame:
    """Ensemble CRPS per key: mean |x - y| minus half the mean |x - x'|, the latter from ranks."""
    w = Window.partitionBy(*keys)
    k, n = F.row_number().over(w.orderBy(sample)), F.count("*").over(w)
    ranked = df.withColumns({"_k": k, "_n": n})
    spread = F.sum((2 * F.col("_k") - F.col("_n") - 1) * F.col(sample)) / (F.first("_n") * F.first("_n"))
    return ranked.groupBy(*keys).agg((F.avg(F.abs(F.col(sample) - F.col(actual))) - spread).alias("crps"))


def cluster_se(df: DataFrame, cluster: Sequence[str], x: str) -> DataFrame:
    """Mean, finite-cluster-corrected standard error and number of clusters."""
    total = df.agg(F.avg(x).alias("mean"), F.count(x).alias("n"))
    sums = df.groupBy(*cluster).agg(F.sum(x).alias("s"), F.count(x).alias("c")).crossJoin(F.broadcast(total))
    sums = sums.withColumn("d", F.col("s") - F.col("c") * F.col("mean"))
    g = F.count("*")
    se = F.sqrt(F.sum(F.col("d") * F.col("d")) * g / (g - 1)) / F.first("n")
    return sums.agg(F.first("mean").alias("mean"), se.alias("se"), g.alias("clusters"))


def grid_best(df: DataFrame, keys: Sequence[str], grid: Sequence[float], loss: Column) -> DataFrame:
    """Per key the grid value (column g in loss) of the smallest loss, the smaller value on ties."""
    long = df.withColumn("g", F.explode(F.array(*map(F.lit, grid))))
    by = long.groupBy(*keys, "g").agg(loss.alias("_l"))
    return by.groupBy(*keys).agg(F.min_by("g", F.struct(F.round("_l", 9), "g")).alias("best"), F.min("_l").alias("loss"))


def blend_weight(y: Column, a: Column, b: Column) -> Column:
    """Least-squares weight of a against b, cut to 0..1."""
    d = a - b
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.sum(d * (y - b)), F.sum(d * d))))


def conformal_quantile(df: DataFrame, keys: Sequence[str], score: str, level: float) -> DataFrame:
    """The ceil((n + 1) * level)-th smallest score per key; null where there are too few."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_k": F.row_number().over(w.orderBy(score)), "_n": F.count("*").over(w)})
    at = F.col("_k") == F.ceil((F.col("_n") + 1) * level)
    return df.groupBy(*keys).agg(F.max(F.when(at, F.col(score))).alias("q"), F.count("*").alias("n"))


def risk_control(losses: DataFrame, knob: str, loss: str, target: float, *, bound: float = 1.0, tol: float = 1e-9) -> DataFrame:
    """(knob, risk, bound, satisfied), one row: the least knob whose (n * risk + bound) / (n + 1) is at most target.

    losses: a row for each sample and knob, knobs rising from the least to the most conservative, losses from 0 to
    bound. Where none reaches the target: the last knob, with satisfied false. The mean loss must not rise along the
    knobs, and no loss may lie outside its range; the query fails if they do. An empty table gives no row.
    """
    by = losses.groupBy(knob).agg(
        F.avg(loss).alias("risk"), F.count("*").alias("n"), F.count_if((F.col(loss) < -tol) | (F.col(loss) > bound + tol)).alias("outside")
    )
    rungs = F.array_sort(F.collect_list(F.struct(F.col(knob).cast("double").alias("knob"), "risk", "n", "outside")))  # one a knob
    row = by.agg(rungs.alias("k")).where(F.size("k") > 0)
    k = F.col("k")
    rises = F.exists(F.sequence(F.lit(1), F.size(k)), lambda i: F.get(k, i)["risk"] > F.get(k, i - 1)["risk"] + tol)
    fault = F.when(F.exists(k, lambda x: x["outside"] > 0), F.lit("losses lie outside their range")).when(rises, F.lit("mean loss rises along the knobs"))
    of = lambda x: (x["n"] * x["risk"] + bound) / (x["n"] + 1)
    met = F.filter(k, lambda x: of(x) <= target)
    x = F.coalesce(F.get(met, F.lit(0)), F.element_at(k, -1))
    row = row.select(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.size(met) > 0).alias("satisfied"), x.alias("x"))
    return row.select(F.col("x.knob").alias(knob), F.col("x.risk").alias("risk"), of(F.col("x")).alias("bound"), "satisfied")
