"""Tables in the cluster's shared folder, and connected components that cut their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: one of our own, in the warehouse of a cluster.

    A temporary folder is only used by a local master, whose tasks run on the driver's machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(shared_dir, "own", None)
        if not found and spark.sparkContext.master.startswith("local["):
            found = tempfile.mkdtemp(prefix="pitpanel-")
        found = found or f"{spark.conf.get('spark.sql.warehouse.dir')}/pitpanel-{uuid.uuid4().hex}"
        shared_dir.own = found
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor never re-runs what came before."""
    return _written(df)[0]


#: Bytes of one batch between Spark and Python while a table is written: whole texts are wide rows.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH[0], None)
    spark.conf.set(*BATCH)
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(BATCH[0])
        else:
            spark.conf.set(BATCH[0], before)
    return spark.read.schema(df.schema).parquet(path), path


def _discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def by_size(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = 200_000) -> DataFrame:
    """Join; the small side is broadcast only if it has at most max_rows (narrow) rows, else both are shuffled."""
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


HUB, HUBS = 10_000, 50_000


def _with_low(edges: DataFrame, n: int) -> DataFrame:
    """edges (u, v), n or fewer, with low: the least v of u's edges.

    An aggregate with map-side combine, then a join. Nodes with over HUB edges, or over n / HUBS of them, so that
    there are HUBS such nodes at most, are joined by broadcast: their edges never meet in one task.
    """
    lows = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("d"))
    if n <= 200_000:  # not more nodes than edges
        return edges.join(F.broadcast(lows.drop("d")), "u")
    lows = materialise(lows)
    most = max(HUB, n // HUBS)
    hubs = lows.where(F.col("d") > most).select("u", F.col("low").alias("hub_low"))
    tagged = edges.join(F.broadcast(hubs), "u", "left")
    few = tagged.where("hub_low is null").drop("hub_low").join(lows.where(F.col("d") <= most).drop("d"), "u")
    return few.unionByName(tagged.where("hub_low is not null").withColumnRenamed("hub_low", "low"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (id, root), root the smallest id reachable; only ids that have an edge.

    Alternating large-star and small-star steps; every round's edges are written and the last round's deleted.
    Loops, repeated and null edges are ignored.
    """
    spark = edges.sparkSession
    size = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    e, path = _written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = e.agg(*size).first()
    while True:
        # large star: what is above u hangs on the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_low(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and what is below it hang on the smallest of those
        small = _with_low(large, 2 * state[0]).select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        (e, now_at), last = _written(small.where("u <> v").distinct()), path
        now, path = e.agg(*size).first(), now_at
        _discard(spark, last)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
