"""Generic nouns bound to the driver's tables, each as a DataFrame and as the SQL of a common table expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    """Exact sums do not depend on row order."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(20,4)")).cast("double")


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(c, digits)


def spread(df: DataFrame, rows: int, *keys: str, each: int = 250_000) -> DataFrame:
    """df by hash of keys in partitions of about `each` rows, so a task's memory does not grow with the table.

    rows: about how many there are (a table's count comes from its footers). Never in fewer partitions than the session has.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *keys)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by year and month: value (null for odd months with one order), total and n."""
    o = table(spark, sf_dir, "orders")
    out = o.groupBy(
        F.col("o_custkey").alias("entity"),
        F.year("o_orderdate").cast("long").alias("epoch"),
        F.month("o_orderdate").cast("long").alias("period"),
    ).agg(money("o_totalprice").alias("total"), F.count("*").alias("n"))
    return out.withColumn("value", F.when((F.col("n") > 1) | (F.col("period") % 2 == 0), F.col("total")))


PANEL = """panel AS (
  SELECT *, CASE WHEN n > 1 OR period % 2 = 0 THEN total END AS value FROM (
    SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS epoch, CAST(month(o_orderdate) AS BIGINT) AS period,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n
    FROM orders GROUP BY 1, 2, 3))"""


def grouped_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel with the customer's nation as grp."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("long").alias("grp"))
    return panel(spark, sf_dir).join(c, "entity")


GPANEL = PANEL + """, gpanel AS (
  SELECT p.*, CAST(c_nationkey AS BIGINT) AS grp FROM panel p JOIN customer ON c_custkey = entity)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: key (user_id, event_type), observed_at (UTC), value, k from the JSON payload."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("observed_at"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


OBS = """obs AS (
  SELECT event_id, user_id, event_type, value, ts AS observed_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as facts: entity (part), grp (supplier), day, qty, disc, net."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("basket"), F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("grp"),
        F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("net"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


FACTS = """facts AS (
  SELECT l_orderkey AS basket, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS entity, l_suppkey AS grp,
         CAST(l_shipdate AS DATE) AS day, l_quantity AS qty, l_discount AS disc,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""
