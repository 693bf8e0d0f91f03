"""The k nearest rows by one number, from sorted places instead of a join of all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.windows import ordered


def nearest(targets: DataFrame, pool: DataFrame, keys: Sequence[str], x: str, target: Sequence[str], peer: str, k: int) -> DataFrame:
    """The k rows of pool nearest to each row of targets by |x|, within equal keys; ties go to the smaller peer.

    targets: keys, x, target columns (a key of it); pool: keys, x, peer and others. Returns target columns, keys, x,
    peer_x, pool's other columns and place (1..k). A row of pool is not near a target whose `peer` column has the
    same value. Of the pool below a target only the last k by (x, peer descending), of the others only the first
    k + 1 by (x, peer), can be among its k nearest, so every target meets 2k + 1 rows by an equi join on their places.
    """
    one = F.lit(1)
    below = F.sum("is_pool").over(ordered(keys, [x]).rangeBetween(-(1 << 63), 0)) - F.sum("is_pool").over(ordered([*keys, x], [F.lit(0)]).rowsBetween(-(1 << 63), (1 << 63) - 1))
    both = targets.withColumn("is_pool", F.lit(0)).unionByName(pool.select(*keys, x).withColumn("is_pool", one), allowMissingColumns=True)
    at = both.withColumn("below", below).where("is_pool = 0").drop("is_pool")
    sides = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.lit("left").alias("side"), (F.col("below") - i).alias("place"))),
        F.transform(F.sequence(F.lit(1), F.lit(k + 1)), lambda i: F.struct(F.lit("right").alias("side"), (F.col("below") + i).alias("place"))),
    )
    asked = at.select("*", F.inline(sides)).drop("below")
    rank = lambda by: F.row_number().over(ordered(keys, [x, by])).cast("long")
    placed = pool.withColumns({"left": rank(F.desc(peer)), "right": rank(F.col(peer))})
    placed = placed.select("*", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("place")) for s in ("left", "right")]))).drop("left", "right")
    placed = placed.withColumnRenamed(x, "peer_x").withColumnRenamed(peer, "peer")
    met = asked.join(placed, [*keys, "side", "place"])
    if peer in targets.columns:
        met = met.where(F.col("peer") != F.col(peer))
    far = F.abs(F.col(x) - F.col("peer_x"))
    return met.withColumn("place", F.row_number().over(ordered([*target, *keys], [far, "peer"]))).where(F.col("place") <= k).drop("side")
