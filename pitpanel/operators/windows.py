"""Windows over entity-period panels. Frames end before the current row unless `inclusive` is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def frame(keys: Sequence[str], order: Sequence[str | Column], n: int | None, inclusive: bool = False) -> WindowSpec:
    """The last n rows (all, if None) strictly before the current one; with it, if inclusive."""
    last = 0 if inclusive else -1
    first = Window.unboundedPreceding if n is None else (-n + 1 if inclusive else -n)
    return ordered(keys, order).rowsBetween(first, last)


def trailing(df: DataFrame, keys, order, n: int | None, aggs: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """df with each aggregate over the frame; all share one window, so one shuffle and one sort."""
    w = frame(keys, order, n, inclusive)
    return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})


def latest_vs_rest(df: DataFrame, keys, order, n: int, value: str, name: str) -> DataFrame:
    """The newest value of the frame minus the mean of its others; null under two values."""
    w = frame(keys, order, n)
    newest, total, count = F.last(value, True).over(w), F.sum(value).over(w), F.count(value).over(w)
    return df.withColumn(name, F.when(count >= 2, newest - (total - newest) / (count - 1)))


def gated_sum(df: DataFrame, keys, order, n: int, value: str, least: int, name: str) -> DataFrame:
    """Sum over the frame where it has at least `least` values."""
    w = frame(keys, order, n)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, F.sum(value).over(w)))


def first_row(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first by order, which must be total."""
    return df.withColumn("_rn", F.row_number().over(ordered(keys, order))).where("_rn = 1").drop("_rn")


def first_and_last(df: DataFrame, keys, time: str, tie: str, value: str) -> DataFrame:
    """Opening and latest value per key and the movement between, in one aggregate without a sort."""
    at = F.struct(time, tie)
    out = df.groupBy(*keys).agg(F.min_by(value, at).alias("opening"), F.max_by(value, at).alias("latest"), F.count("*").alias("n"))
    return out.withColumn("movement", F.col("latest") - F.col("opening"))


def percent_rank_null_safe(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """percent_rank among the rows of the group with a value; null stays null."""
    w = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.percent_rank().over(w)))


def rank_pct(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """Mean rank of ties over the number of values; null stays null."""
    w = Window.partitionBy(*keys, F.col(value).isNull())
    rank, ties = F.rank().over(w.orderBy(value)), F.count("*").over(Window.partitionBy(*keys, F.col(value).isNull(), value))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2) / F.count("*").over(w)))


def share_of_group(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys))))


def top_share(df: DataFrame, keys, order, k: int) -> Column:
    """True for the first ceil(size / k) rows of the group by a total order."""
    size = F.count("*").over(Window.partitionBy(*keys))
    return F.row_number().over(ordered(keys, order)) <= F.ceil(size / k)
