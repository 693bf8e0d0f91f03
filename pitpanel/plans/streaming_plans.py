"""Streaming jobs run over the events table as a file stream to the end, against SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.plans.bindings import OBS, money, r, table
from pitpanel.sources import tables as T
from pitpanel.streaming import jobs as J

QUERIES, SQL = {}, {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def stream(spark, sf):
    """events as a file stream of three batches, in order of time, observed_at as an instant.

    A batch is a third of the time in files of its own: a part of a third that came after other parts of it would be
    behind the watermark.
    """
    path = T.workspace(spark)
    e = table(spark, sf, "events").withColumn("observed_at", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "value", "observed_at")
    at = F.col("observed_at").cast("double")
    low, high, rows = e.agg(F.min(at), F.max(at), F.count("*")).first()
    third = F.least(F.floor((at - low) / (high - low) * 3), F.lit(2))
    files = min(64, max(1, rows // 1_000_000))
    for k in range(3):
        e.where(third == k).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


@q("stream_append_log", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def append_log(spark, sf):
    out = T.workspace(spark)
    J.run_available(J.append_log(stream(spark, sf), "observed_at"), out, T.workspace(spark), partition="day")
    return spark.read.parquet(out).select("event_id", "day")


@q("stream_dedup", f"WITH {OBS} SELECT count(*) AS n, count(DISTINCT event_id) AS ids, count(*) FILTER (event_id % 50 = 0) AS conflicts, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4) AS kept FROM obs")
def dedup(spark, sf):
    """Every event comes twice, one in fifty of them the second time with another value: repeats go, conflicts aside."""
    s = stream(spark, sf)
    other = F.when((F.col("event_id") % 50 == 0) & (F.col("copy") == 2), 1000.0).otherwise(0.0)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.col("value") + other)
    seen, conflicts = T.workspace(spark), T.workspace(spark)
    once = J.dedup(twice, "observed_at", ["event_id", "value"], "1 hour")
    J.run_batches(once, J.novel_or_conflict(spark, seen, conflicts, ["event_id"], ["value"], ["copy"]), T.workspace(spark), mode="append")
    kept = spark.read.parquet(seen).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), r(money("value"), 4).alias("kept"))
    return kept.crossJoin(F.broadcast(spark.read.parquet(conflicts).agg(F.count("*").alias("conflicts")))).select("n", "ids", "conflicts", "kept")


@q("stream_cutoff_late", f"WITH {OBS}, o AS (SELECT *, CAST(observed_at AS DATE) AS day FROM obs) SELECT day, count(*) FILTER (hour(observed_at) < 12) AS admitted, count(*) FILTER (hour(observed_at) >= 12) AS late FROM o GROUP BY 1")
def cutoff_late(spark, sf):
    s = stream(spark, sf).withColumn("day", F.to_date("observed_at"))
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    cut = days.withColumn("cutoff", F.expr("cast(day as timestamp) + interval 12 hours - interval 1 microsecond"))
    parts = []
    for name, df in zip(("admitted", "late"), J.before_cutoff(s, cut, "day", "observed_at", "cutoff"), strict=True):
        out = T.workspace(spark)
        J.run_available(df.select("day", F.lit(name).alias("kind")), out, T.workspace(spark))
        parts.append(spark.read.parquet(out))
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return parts[0].unionByName(parts[1]).groupBy("day").agg(n("admitted"), n("late"))


@q("stream_latest_state", "SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS opening, arg_max(value, (ts, event_id)) AS latest, count(*) AS n FROM events GROUP BY 1, 2")
def latest_state(spark, sf):
    keys, out = ["user_id", "event_type"], T.workspace(spark)
    J.run_to_table(stream(spark, sf), lambda b: J.latest_state(b, keys, "observed_at", "event_id", "value"), out, T.workspace(spark))
    return J.latest_of(spark.read.parquet(out), keys)


@q("stream_fill_rate", "WITH b AS (SELECT date_trunc('day', ts) AS bucket, event_type, ts, value FROM events), c AS (SELECT bucket, event_type, count(*) AS n, count(*) FILTER (value > 50) AS hits FROM b GROUP BY 1, 2) SELECT *, least(round(n / 100.0, 6), 1.0) AS fill_rate, greatest(1000.0 - 10.0 * n, 0.0) AS overlay FROM c WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def fill_rate(spark, sf):
    out = T.workspace(spark)
    J.run_available(J.tumbling_rate(stream(spark, sf), "observed_at", "1 day", "1 hour", ["event_type"], F.col("value") > 50), out, T.workspace(spark))
    filled = J.fill_and_overlay(spark.read.parquet(out), 100.0, 1000.0, 10.0)
    return filled.withColumn("fill_rate", r("fill_rate", 6))


@q("stream_traits", "WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT user_id, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE) / count(*), 6) AS mean, min(value) AS low, max(value) AS high, CAST(min(floor(value)) FILTER (k >= ceil(c * 0.9)) AS BIGINT) AS p90 FROM k GROUP BY 1")
def traits(spark, sf):
    out = T.workspace(spark)
    J.run_to_table(stream(spark, sf), lambda b: J.traits(b, ["user_id"], "value"), out, T.workspace(spark))
    return J.traits_of(spark.read.parquet(out), ["user_id"], 0.9).select("user_id", "n", r("mean", 6).alias("mean"), "low", "high", F.col("quantile").alias("p90"))


@q("stream_online_conformal")
def online_conformal(spark, sf):
    out = T.workspace(spark)
    J.run_batches(stream(spark, sf), J.online_conformal(out, T.workspace(spark), "event_type", "event_id", "value"), T.workspace(spark), mode="append")
    return spark.read.parquet(out).drop("batch")


@q("stream_freshness", "SELECT event_type AS feed, count(*) AS rows, max(ts) AS newest, date_diff('second', max(ts), TIMESTAMP '2024-02-15') > 3600 AS late FROM events GROUP BY 1")
def freshness(spark, sf):
    out = T.workspace(spark)
    newest = lambda b: b.groupBy("event_type").agg(F.count("*").alias("rows"), F.max("observed_at").alias("newest"))
    J.run_to_table(stream(spark, sf), newest, out, T.workspace(spark))
    state = spark.read.parquet(out).groupBy(F.col("event_type").alias("feed")).agg(F.sum("rows").alias("rows"), F.max("newest").alias("newest"))
    age = F.lit("2024-02-15").cast("timestamp").cast("double") - F.col("newest").cast("double")
    return state.withColumn("late", age > 3600)


@q("stream_evidence_state", """WITH n AS (SELECT user_id, event_type, event_id AS id, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events), w AS (SELECT epoch_ms(max(ts)) - 3600000 AS mark FROM events)
  SELECT user_id, event_type, id, CASE WHEN nxt <= ts + INTERVAL 24 HOUR THEN nxt ELSE ts + INTERVAL 24 HOUR END AS ended_at, CASE WHEN nxt <= ts + INTERVAL 24 HOUR THEN 'superseded' ELSE 'expired' END AS why FROM n, w WHERE nxt IS NOT NULL OR epoch_ms(ts + INTERVAL 24 HOUR) < mark""")
def evidence_state(spark, sf):
    ended = T.workspace(spark)
    each = J.evidence_ends(ended, T.workspace(spark), ["user_id", "event_type"], "event_id", "observed_at", 24, 1)
    J.run_batches(stream(spark, sf), each, T.workspace(spark), mode="append")
    return spark.read.parquet(ended).drop("batch")
