"""Joins by blocks give a plain join's rows, and large groups are dealt to many cells."""

from pyspark.sql import functions as F

from pitpanel.operators import graph as G
from pitpanel.operators.blocks import block_join


def test_block_join(spark):
    a = spark.createDataFrame([(i % 3 if i % 10 else None, i) for i in range(90)], "k int, x int").union(spark.createDataFrame([(7, 1), (0, 0), (0, 0)], "k int, x int"))
    b = spark.createDataFrame([(i % 4, i) for i in range(70)], "k int, y int")
    want = sorted(map(tuple, a.join(b, "k").collect()))
    for each in (5, 2000):
        assert sorted(map(tuple, block_join(a, b, ["k"], each).collect())) == want


def test_one_large_group_is_dealt_out(spark):
    s = spark.range(6000).select((F.col("id") % 1).alias("k"), F.col("id"))
    out = G.competes(s, ["k"], "id").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in out) == 6000 * 5999
    assert len(out) > 3
