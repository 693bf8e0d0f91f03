"""Graph queries as joins over nodes(id, kind) and edges(src, dst, kind, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.blocks import block_join


def neighbors(edges: DataFrame, kinds: Sequence[str], sources: DataFrame | None = None) -> DataFrame:
    """Typed out-edges; of given sources (id) only, if any."""
    out = edges.where(F.col("kind").isin(*kinds))
    return out if sources is None else out.join(sources.withColumnRenamed("id", "src"), "src", "left_semi")


def strongest_in_edge(edges: DataFrame, kind: str) -> DataFrame:
    """Per target the source of its heaviest edge, the smaller source on ties."""
    e = edges.where(F.col("kind") == kind)
    return e.groupBy("dst").agg(F.max_by("src", F.struct("weight", -F.col("src"))).alias("src"), F.max("weight").alias("weight"))


def competes(members: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """Directed pairs of different members of a group: all its pairs, so a large group is dealt to many tasks."""
    one = members.select(*group, member)
    return block_join(one.withColumnRenamed(member, "src"), one.withColumnRenamed(member, "dst"), group).where("src <> dst")


def paired_delta(rows: DataFrame, task: Sequence[str], arm: str, value: str, incumbent: str, challenger: str) -> DataFrame:
    """Challenger minus incumbent per task in one aggregate, for tasks that have both."""
    pick = lambda a: F.max(F.when(F.col(arm) == a, F.col(value)))
    out = rows.groupBy(*task).agg(pick(incumbent).alias("old"), pick(challenger).alias("new"))
    return out.where("old is not null and new is not null").withColumn("delta", F.col("new") - F.col("old"))
