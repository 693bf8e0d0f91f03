"""Joins whose result is pairs of all rows of a group with all others: block by block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4000


def block_join(a: DataFrame, b: DataFrame, keys: Sequence[str], each: int = 2000) -> DataFrame:
    """a and b joined on keys; other columns of a and b must have different names. Null keys meet nothing.

    A group's rows are dealt by hash to blocks of about `each` rows on either side, and every pair of blocks is a cell of its
    own. So no task makes more than its share of the pairs of a few large groups; a row is sent once for each block that it meets.
    """
    size = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / each).cast("int").alias(n))
    blocks = size(a, "_ma").join(size(b, "_mb"), list(keys))
    cells = blocks.agg(F.sum(F.col("_ma").cast("long") * F.col("_mb"))).first()[0] or 1
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    met = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda df: df.drop("_ma", "_mb").repartition(min(cells, MOST), *keys, "_i", "_j")
    x = deal(a.join(blocks, list(keys)).withColumn("_i", own(a, "_ma")).withColumn("_j", met("_mb")))
    y = deal(b.join(blocks, list(keys)).withColumn("_j", own(b, "_mb")).withColumn("_i", met("_ma")))
    return x.hint("merge").join(y, [*keys, "_i", "_j"]).drop("_i", "_j")
