"""As-of joins. Strict ones admit only what lies before the target; none joins every target with all its history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    targets: DataFrame, sources: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], *, strict: bool = True
) -> DataFrame:
    """targets with the columns `carry` of the newest source row of the same key before it (or at it, if not strict).

    Targets and sources are unioned and sorted once per key; the newest source row so far is carried as one struct,
    so nulls in it are kept. `order` (with ties broken by the sources' carried columns) must be the same columns in
    both. Linear in targets and sources; a target without an earlier source has nulls.
    """
    own = targets.columns
    row = F.struct(*carry)
    left = targets.withColumns({"_row": F.lit(None), "_side": F.lit(0 if strict else 1)})
    right = sources.select(*keys, *order, row.alias("_row"), F.lit(1 if strict else 0).alias("_side"))
    both = right.unionByName(left.withColumn("_row", F.lit(None).cast(right.schema["_row"].dataType)), allowMissingColumns=True)
    both = both.withColumn("_target", F.col("_side") == (0 if strict else 1))
    w = Window.partitionBy(*keys).orderBy(*order, "_side", "_row").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    found = both.withColumn("_found", F.last("_row", True).over(w)).where("_target")
    return found.select(*own, *[F.col("_found")[c].alias(f"asof_{c}") for c in carry])


def asof_cutoff_revision(observations: DataFrame, cutoffs: DataFrame, keys, period: str, at: str, cutoff: str, rank: Sequence[Column]) -> DataFrame:
    """The newest admissible revision per key and period: observed at or before the period's cutoff, by `rank`."""
    admitted = observations.join(cutoffs, period).where(F.col(at) <= F.col(cutoff))
    w = Window.partitionBy(*keys, period).orderBy(*rank)
    return admitted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookback(df: DataFrame, keys, period: str, n: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the same key's rows of periods [p - n, p - 1] of the calendar, whatever rows there are."""
    w = Window.partitionBy(*keys).orderBy(period).rangeBetween(-n, -1)
    return df.withColumns({k: v.over(w) for k, v in aggs.items()})
