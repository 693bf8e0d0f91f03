"""Aggregates: shares, shrinkage, moments, rank correlation, reconciliation. Sums are pre-aggregated before a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_level_share(df: DataFrame, group: Sequence[str], member: str, value: Column, name: str) -> DataFrame:
    """A member's part of its group's total: one aggregate per member, the totals by window over those."""
    m = df.groupBy(*group, member).agg(value.alias("_v"))
    return m.select(*group, member, F.try_divide(F.col("_v"), F.sum("_v").over(Window.partitionBy(*group))).alias(name))


def shrunk_rate(total: Column, n: Column, prior: Column, k: float) -> Column:
    """(total + k * prior) / (n + k)."""
    return F.try_divide(total + k * prior, n + k)


def mean_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (ties - 1) / 2)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group, ties at mean rank; rows with a null are left out."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = mean_rank(mean_rank(both, keys, x, "_rx"), keys, y, "_ry")
    return both.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def sample_skew(x: str) -> Column:
    """Bias-corrected skewness, null under three values."""
    n = F.count(x)
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def hhi(df: DataFrame, group: Sequence[str], member: str, value: Column) -> DataFrame:
    """Sum of squared shares of the members per group."""
    s = two_level_share(df, group, member, value, "_s")
    return s.groupBy(*group).agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.count("*").alias("members"))


def total_and_by_group(df: DataFrame, group: str, aggs: Sequence[Column], label: str = "all") -> DataFrame:
    """A row per group and one for all, in one pass."""
    out = df.rollup(group).agg(F.grouping(group).alias("_g"), *aggs)
    return out.withColumn(group, F.when(F.col("_g") == 1, label).otherwise(F.col(group))).drop("_g")


def credits(df: DataFrame, rows: Sequence[tuple[str, Column, Column]], key: str) -> DataFrame:
    """Several kinds of credit unpivoted from one scan and summed. rows: (kind, who gets it, how much)."""
    structs = [F.struct(F.lit(k).alias("kind"), who.alias(key), x.cast("double").alias("x")) for k, who, x in rows]
    long = df.select(F.inline(F.array(*structs))).where(F.col("x").isNotNull() & (F.col("x") != 0))
    return long.groupBy(key, "kind").agg(F.sum("x").alias("credit"), F.count("*").alias("events"))


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: dict[str, float | None]) -> DataFrame:
    """(field, changed, beyond, largest, only_old, only_new), a row for each field, from one join and one aggregate.

    fields: name -> tolerance of a number, None for others. changed: rows of both whose values differ, nulls being
    equal; beyond: by more than the tolerance; largest: the largest difference; only_*: keys that one of them has.
    """
    a = old.select(*keys, F.struct(*fields).alias("_old"))
    b = new.select(*keys, F.struct(*fields).alias("_new"))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    aggs = [F.count_if(F.col("_new").isNull()).alias("only_old"), F.count_if(F.col("_old").isNull()).alias("only_new")]
    rows = []
    for i, (f, tolerance) in enumerate(fields.items()):
        x, y = F.col(f"_old.{f}"), F.col(f"_new.{f}")
        aggs.append(F.count_if(both & ~x.eqNullSafe(y)).alias(f"_changed{i}"))
        cells = [F.lit(f).alias("field"), F.col(f"_changed{i}").alias("changed")]
        if tolerance is None:
            cells += [F.lit(None).cast("long").alias("beyond"), F.lit(None).cast("double").alias("largest")]
        else:
            aggs += [F.count_if(both & (F.abs(x - y) > tolerance)).alias(f"_beyond{i}"), F.max(F.when(both, F.abs(x - y))).alias(f"_largest{i}")]
            cells += [F.col(f"_beyond{i}").alias("beyond"), F.round(F.col(f"_largest{i}").cast("double"), 6).alias("largest")]
        rows.append(F.struct(*cells))
    return a.join(b, list(keys), "full_outer").agg(*aggs).select(F.inline(F.array(*rows)), "only_old", "only_new")
