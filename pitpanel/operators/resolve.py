"""Identity resolution and guards on joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_key(c: Column) -> Column:
    """Upper case, without a generational suffix, letters only, single blanks."""
    x = F.regexp_replace(F.upper(F.trim(c)), r"\s+(JR|SR|II|III|IV|V)\.?$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^A-Z ]", ""), r" +", " "))


def unique_candidate(df: DataFrame, keys: Sequence[str], levels: Sequence[tuple[str, Column]], id_col: str) -> DataFrame:
    """The id of the strictest level at which a key has exactly one candidate; `level` names it."""
    one = {n: F.when(F.count_distinct(F.when(p, F.col(id_col))) == 1, F.max(F.when(p, F.col(id_col)))) for n, p in levels}
    out = df.groupBy(*keys).agg(*[c.alias(f"_{n}") for n, c in one.items()])
    level = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in one])
    return out.select(*keys, F.coalesce(*[F.col(f"_{n}") for n in one]).alias("resolved"), level.alias("level"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not unique: a join on them would fan out."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def reconcile_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either side with presence flags."""
    a, b = (x.select(*keys).distinct().withColumn(n, F.lit(True)) for x, n in ((left, "in_left"), (right, "in_right")))
    out = a.join(b, list(keys), "full")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_left", "in_right")})


def two_stage(names: DataFrame, known: DataFrame, strict: Column, loose: Column, id_col: str) -> DataFrame:
    """names (name) resolved by the strict key, else the loose one; ambiguous keys resolve nothing."""

    def one(key):
        k = known.select(key.alias("key"), id_col).groupBy("key").agg(F.count_distinct(id_col).alias("c"), F.max(id_col).alias("i"))
        return k.where("c = 1").drop("c")

    out = names.withColumns({"_s": strict, "_l": loose})
    out = out.join(one(strict).select(F.col("key").alias("_s"), F.col("i").alias("_i1")), "_s", "left")
    out = out.join(one(loose).select(F.col("key").alias("_l"), F.col("i").alias("_i2")), "_l", "left")
    method = F.when(F.col("_i1").isNotNull(), "exact").when(F.col("_i2").isNotNull(), "loose")
    return out.select(*names.columns, F.coalesce("_i1", "_i2").alias("resolved"), method.alias("method"))


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], distance: Sequence[Column], left_key: str, right_key: str) -> DataFrame:
    """For each left row the right row of the same class with the smallest distances, the right key breaking ties."""
    w = Window.partitionBy(left_key).orderBy(*distance, right_key)
    return left.join(right, list(on)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
