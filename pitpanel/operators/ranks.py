"""Ranks, running sums and quantiles within groups of any size, without a window over a whole group.

Rows are cut into ranges of (keys, order), each sorted by itself; what a group has in the ranges before is added from
a table of a row for each group and range. The ranges are written with their numbers before anything is
counted: planned twice, they could be cut apart at other values for the sums than for the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Save = Callable[[DataFrame], DataFrame]


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column], save: Save) -> DataFrame:
    """df with _part, and for each sum _before_<name> (in the group's earlier ranges) and _all_<name> (in the group)."""
    parts = save(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "_part").agg(*[x.alias(n) for n, x in sums.items()])
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums] + [F.sum(n).over(group).alias(f"_all_{n}") for n in sums]
    before = sizes.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *cols)
    on = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return parts.join(before, on).drop("_of", *[f"_key{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str], save: Save) -> DataFrame:
    """df with, for each sum (name -> column), name: that column summed up to the row, and name_all: over the group.

    The order must be total within a group: rows that are equal in it have the sums of one of their orders.
    """
    out = _ranged(df, keys, order, {f"s{i}": F.sum(c) for i, c in enumerate(sums.values())}, save)
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    new = {}
    for i, (name, c) in enumerate(sums.items()):
        new |= {name: F.col(f"_before_s{i}") + F.sum(c).over(upto), f"{name}_all": F.col(f"_all_s{i}")}
    return out.withColumns(new).select(*df.columns, *new)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], save: Save, name: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in its group by a total order, and name_all: the group's rows."""
    return running(df.withColumn("_one", F.lit(1)), keys, order, {name: "_one"}, save).drop("_one")


def ranked(df: DataFrame, keys: Sequence[str], x: str, save: Save, *, down: bool = False, name: str = "rank") -> DataFrame:
    """df with the rank of x in its group (equal values share the first place), name_ties: rows of that value, name_all."""
    by = F.desc(x) if down else F.asc(x)
    out = _ranged(df, keys, [by], {"n": F.count("*")}, save)  # a range holds all rows of a value
    own = Window.partitionBy("_part", *keys)
    new = {name: F.col("_before_n") + F.rank().over(own.orderBy(by)), f"{name}_ties": F.count("*").over(Window.partitionBy("_part", *keys, x)), f"{name}_all": F.col("_all_n")}
    return out.withColumns(new).select(*df.columns, *new)


def mean_rank(df: DataFrame, keys: Sequence[str], x: str, name: str, save: Save) -> DataFrame:
    """df with the rank of x in its group, equal values at the mean of their places."""
    out = ranked(df, keys, x, save, name="_r")
    return out.select(*df.columns, (F.col("_r") + (F.col("_r_ties") - 1) / 2).alias(name))


def placed(df: DataFrame, keys: Sequence[str], x: str, tie: Sequence[str], save: Save, *, place: str, mean: str, sums: Mapping[str, str] | None = None) -> DataFrame:
    """numbered from the largest x down (equal ones by tie), running sums in that order, and the mean rank of x from the smallest up, in one pass.

    Ranges are cut by x alone, so equal values are in one; the sums are of the row itself and those before it.
    """
    sums, by = dict(sums or {}), F.desc(x)
    out = _ranged(df, keys, [by], {"n": F.count("*"), **{f"s{i}": F.sum(c) for i, c in enumerate(sums.values())}}, save)
    own = Window.partitionBy("_part", *keys)
    down = own.orderBy(by, *tie).rowsBetween(Window.unboundedPreceding, 0)
    ties, all_of = F.count("*").over(Window.partitionBy("_part", *keys, x)), F.col("_all_n")
    above = F.col("_before_n") + F.rank().over(own.orderBy(by)) - 1  # larger ones
    new = {place: F.col("_before_n") + F.count("*").over(down), f"{place}_all": all_of, mean: all_of - above - (ties - 1) / 2}
    new |= {n: F.col(f"_before_s{i}") + F.sum(c).over(down) for i, (n, c) in enumerate(sums.items())}
    return out.withColumns(new).select(*df.columns, *new)


def bands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n_bands: int, name: str, save: Save) -> DataFrame:
    """df with bands 0..n_bands-1 of equal size up to one, by a total order."""
    out = numbered(df, keys, order, save, "_k")
    return out.select(*df.columns, F.floor((F.col("_k") - 1) * n_bands / F.col("_k_all")).alias(name))


def quantiles(df: DataFrame, keys: Sequence[str], x: str, at: Mapping[str, float], save: Save) -> DataFrame:
    """(keys, a column for each quantile): interpolated between the two values about it; nulls are left out.

    Equal values are counted first, so a value that many rows share is one row of its range.
    """
    return weighted_quantiles(df.withColumn("_one", F.lit(1)), keys, x, "_one", at, save)


def weighted_quantiles(df: DataFrame, keys: Sequence[str], x: str, times: str, at: Mapping[str, float], save: Save) -> DataFrame:
    """quantiles of a table in which each row stands for `times` rows."""
    values = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_x")).agg(F.sum(times).alias("_c"))
    upto = running(values, keys, ["_x"], {"_n": "_c"}, save)

    def value(q: float) -> Column:
        place = (F.col("_n_all") - 1) * F.lit(q)
        low = F.min(F.when(F.col("_n") > F.floor(place), F.col("_x")))
        high = F.min(F.when(F.col("_n") > F.ceil(place), F.col("_x")))
        part = F.first(place - F.floor(place))
        return low + (high - low) * part

    return upto.groupBy(*keys).agg(*[value(q).alias(n) for n, q in at.items()])


def rank_quality(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], hit: str, save: Save) -> DataFrame:
    """(keys, ap, ndcg): average precision and NDCG of a ranking by score, higher first; hit: 0 or 1."""
    one = df.withColumn("_one", F.lit(1))
    placed = running(one, keys, [F.desc(score), *tie], {"_k": "_one", "_hits": hit}, save)
    gain = F.sum(F.col(hit) / F.log2(F.col("_k") + 1)).alias("_gain")
    ap = F.try_divide(F.sum(F.col(hit) * F.col("_hits") / F.col("_k")), F.sum(hit)).alias("ap")
    # at best, the hits have the first places: the gain of the first so many places
    found = placed.groupBy(*keys).agg(ap, gain, F.sum(F.when(F.col("_k") <= F.col("_hits_all"), 1 / F.log2(F.col("_k") + 1))).alias("_ideal"))
    return found.select(*keys, "ap", F.try_divide("_gain", F.coalesce("_ideal", F.lit(0.0))).alias("ndcg"))


def discrimination(df: DataFrame, keys: Sequence[str], score: str, hit: str, save: Save) -> DataFrame:
    """(keys, roc_auc, average_precision) of a score, ties counted as such; null for a group with one class only.

    Rows of equal score are counted first; the rest are running sums over the distinct scores from above.
    """
    g = df.where(F.col(score).isNotNull() & F.col(hit).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("_n"), F.sum(hit).alias("_h"))
    c = running(g, keys, [F.desc(score)], {"_cn": "_n", "_ch": "_h"}, save)
    misses = F.col("_cn_all") - F.col("_ch_all")
    below = misses - (F.col("_cn") - F.col("_ch")) + (F.col("_n") - F.col("_h")) / 2
    both = F.first("_ch_all") * F.first(misses)
    ap = F.when(both > 0, F.sum(F.col("_h") * F.col("_ch") / F.col("_cn")) / F.first("_ch_all"))
    return c.groupBy(*keys).agg(F.when(both > 0, F.sum(F.col("_h") * below) / both).alias("roc_auc"), ap.alias("average_precision"))
