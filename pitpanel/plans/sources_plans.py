"""Scans and sinks: every query writes what it tests to the workspace and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.operators import windows as W
from pitpanel.plans.bindings import OBS, observations, r, table
from pitpanel.sources import tables as T

QUERIES, SQL = {}, {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@q("scan_param_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000")
def param_query(spark, sf):
    o = table(spark, sf, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_orderstatus = :status AND array_contains(:levels, o_orderpriority) AND o_totalprice > :least", args={"status": "F", "levels": F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), "least": 100000}, o=o)


@q("sql_template", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def template(spark, sf):
    text = T.render("SELECT ${key}, count(*) AS n FROM {src} GROUP BY 1", key="l_returnflag")
    return spark.sql(text, src=table(spark, sf, "lineitem"))


@q("write_truncate_append", "SELECT s_suppkey AS k, s_acctbal AS bal, NULL::VARCHAR AS name FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_name FROM customer")
def truncate_append(spark, sf):
    path = T.workspace(spark)
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_name").alias("name"))
    T.write(s.limit(3), path, "overwrite")
    T.write(s, path, "overwrite", cluster=["k"])
    T.write(c, path, "append")
    return T.read(spark, path).select("k", "bal", "name")


@q("write_idempotent_batch", "SELECT c_custkey, c_mktsegment AS batch_id FROM customer")
def idempotent(spark, sf):
    path = T.workspace(spark)
    c = table(spark, sf, "customer")
    for segment in sorted(x[0] for x in c.select("c_mktsegment").distinct().collect()):  # five segments by the schema
        rows = c.where(F.col("c_mktsegment") == segment).select("c_custkey")
        for _ in range(2):
            T.append_batch(rows, path, segment)
    return spark.read.parquet(path)


@q("replace_slice", "SELECT o_orderkey, o_totalprice + (year(o_orderdate) = 1997)::INT AS price, CAST(year(o_orderdate) AS INTEGER) AS epoch FROM orders")
def replace_slice(spark, sf):
    path = T.workspace(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("epoch"))
    T.write(o, path, "overwrite", ["epoch"])
    T.replace_slices(o.where("epoch = 1997").withColumn("price", F.col("price") + 1), path, ["epoch"])
    return spark.read.parquet(path)


@q("replace_keyed_upload", "SELECT c_custkey, c_acctbal * (CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 4 THEN 2 ELSE 1 END) AS bal, c_mktsegment AS source, c_nationkey AS period FROM customer")
def keyed_upload(spark, sf):
    path = T.workspace(spark)
    c = table(spark, sf, "customer").where("c_nationkey < 25").select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("period"))
    T.write(c, path, "overwrite", ["source", "period"])
    T.replace_slices(c.where("source = 'MACHINERY' and period = 4").withColumn("bal", 2 * F.col("bal")), path, ["source", "period"])
    return spark.read.parquet(path)


@q("append_snapshot", "SELECT event_id, user_id, CAST('2024-02-01' AS DATE) AS day FROM events UNION ALL SELECT event_id, user_id, CAST('2024-02-02' AS DATE) FROM events WHERE event_id % 2 = 0")
def snapshot(spark, sf):
    path = T.workspace(spark)
    e = table(spark, sf, "events").select("event_id", "user_id")
    for day, rows in (("2024-02-01", e), ("2024-02-02", e.where("event_id % 2 = 0"))):
        stamped = T.stamp(rows, F.lit(f"{day} 12:00:00").cast("timestamp"), day).withColumn("day", F.to_date("observed_at"))
        T.write(stamped, path, "append", ["day"])
    return spark.read.parquet(path).where("length(content_hash) = 64").select("event_id", "user_id", "day")


NOVEL = "WITH old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, c_acctbal + (c_custkey % 5 = 0)::INT AS v FROM customer)"


@q("append_novel_or_conflict", f"{NOVEL} SELECT k, v, 'novel' AS kind FROM new WHERE k NOT IN (SELECT k FROM old) UNION ALL SELECT new.k, new.v, 'conflict' FROM new JOIN old USING (k) WHERE new.v IS DISTINCT FROM old.v")
def novel(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + (F.col("c_custkey") % 5 == 0).cast("int")).alias("v"))
    fresh, clash = T.novel(new.union(new), old, ["k"], ["v"])
    return fresh.withColumn("kind", F.lit("novel")).unionByName(clash.withColumn("kind", F.lit("conflict")))


@q("partitioned_ddl", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def partitioned(spark, sf):
    path = T.workspace(spark)
    T.write(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey"), path, "overwrite", ["l_returnflag"], ["l_orderkey"])
    return spark.read.parquet(path).where("l_returnflag = 'R'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@q("evolve_schema", "SELECT n_nationkey AS k, n_name AS name, NULL::INT AS region FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 10")
def evolve(spark, sf):
    """A table whose later files have one more column: rows of the earlier ones have it empty."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    path = T.workspace(spark)
    T.write(n.where("k < 10").drop("region"), path, "overwrite")
    T.write(n.where("k >= 10"), path, "append")
    return T.read(spark, path)


@q("filtered_view", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') = 'MACHINERY' OR nullif(c_mktsegment, 'BUILDING') IS NULL")
def filtered(spark, sf):
    c = table(spark, sf, "customer").withColumn("s", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return c.where((F.col("s") == "MACHINERY") | F.col("s").isNull()).select("c_custkey")


@q("snapshot_backup", "SELECT 'run' AS kind, 'nation' AS name, 'copied' AS status, count(*) AS rows FROM nation UNION ALL SELECT 'run', 'region', 'copied', count(*) FROM region UNION ALL SELECT 'run', 'absent', 'missing', 0 UNION ALL SELECT 'rerun', 'nation', 'kept', count(*) FROM nation UNION ALL SELECT 'rerun', 'region', 'kept', count(*) FROM region UNION ALL SELECT 'rerun', 'absent', 'missing', 0 UNION ALL SELECT 'listed', 'nation', '2024-02-15', count(*) FROM nation UNION ALL SELECT 'listed', 'region', '2024-02-15', count(*) FROM region")
def backup(spark, sf):
    """A day's run, a rerun that keeps the clones, and the list, without a clone of six weeks before."""
    into, names = T.workspace(spark), {"nation": f"{sf}/nation.parquet", "region": f"{sf}/region.parquet", "absent": f"{sf}/absent.parquet"}
    T.backup(spark, {"nation": names["nation"]}, into, "2024-01-01", 30)
    runs = [T.backup(spark, names, into, "2024-02-15", 30).select(F.lit(k).alias("kind"), "name", "status", "rows") for k in ("run", "rerun")]
    listed = T.backups(spark, into, ["nation", "region", "absent"], "2024-02-15", 30)
    return runs[0].unionByName(runs[1]).unionByName(listed.select(F.lit("listed").alias("kind"), "name", F.col("day").cast("string").alias("status"), "rows"))


@q("feed_freshness", "SELECT 'events' AS feed, count(*) AS rows, CAST(max(ts) AS TIMESTAMP) AS newest, CASE WHEN date_diff('second', max(ts), TIMESTAMP '2024-02-15') / 3600.0 > 200 THEN 'stale' ELSE 'ok' END AS state FROM events UNION ALL SELECT 'orders', count(*), max(o_orderdate), 'idle' FROM orders UNION ALL SELECT 'lineitem', count(*), max(l_shipdate), 'stale' FROM lineitem UNION ALL SELECT 'none', 0, NULL, 'empty' UNION ALL SELECT 'absent', 0, NULL, 'missing'")
def fresh(spark, sf):
    o = table(spark, sf, "orders")
    feeds = {
        "events": (table(spark, sf, "events"), "ts", 200.0, True),
        "orders": (o, "o_orderdate", 24.0, False),
        "lineitem": (table(spark, sf, "lineitem"), "l_shipdate", 24.0, True),
        "none": (o.where("o_orderkey < 0"), "o_orderdate", 24.0, True),
        "absent": (T.found(spark, f"{sf}/absent.parquet"), "at", 24.0, True),
    }
    return T.freshness(feeds, "2024-02-15 00:00:00").select("feed", "rows", "newest", "state")


@q("csv_loose_schema", "SELECT c_custkey AS id, round(c_acctbal, 2) AS balance FROM customer")
def csv_loose(spark, sf):
    path = T.workspace(spark)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("Cust ID"), F.concat(F.format_string("%.2f", "c_acctbal"), F.lit("%")).alias("BAL"))
    c.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("Cust ID"), F.lit("junk").alias("BAL"))).write.option("header", True).csv(path)
    alias = {"cust id": "id", "customer": "id", "bal": "balance"}
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(*[F.col(f"`{x}`").alias(alias[x.lower()]) for x in raw.columns if x.lower() in alias])
    rows = rows.select(F.col("id").try_cast("long").alias("id"), F.regexp_replace("balance", "%", "").try_cast("double").alias("balance"))
    return rows.where("id is not null and balance is not null")


@q("csv_string_first", "SELECT c_custkey AS id, round(c_acctbal - 5000, 2) AS money FROM customer")
def csv_strings(spark, sf):
    path = T.workspace(spark)
    x = F.col("c_acctbal") - 5000
    text = F.when(x < 0, F.concat(F.lit("($"), F.format_number(-x, 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(x, 2)))
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), text.alias("money")).write.option("header", True).csv(path)
    raw = spark.read.option("header", True).csv(path)
    value = F.regexp_replace("money", r"[$,()]", "").try_cast("double")
    return raw.select(F.col("id").cast("long").alias("id"), r(F.when(F.col("money").startswith("("), -value).otherwise(value), 2).alias("money"))


@q("csv_two_block_split", "SELECT 'entry' AS block, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders UNION ALL SELECT 'item', count(*), sum(p_partkey)::BIGINT FROM part")
def two_block(spark, sf):
    path = T.workspace(spark)
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item"))
    e.unionByName(p, allowMissingColumns=True).write.option("header", True).csv(path)
    raw = spark.read.option("header", True).csv(path)
    block = lambda c: raw.where(F.col(c).isNotNull()).agg(F.count("*").alias("n"), F.sum(F.col(c).cast("long")).alias("total")).select(F.lit(c).alias("block"), "n", "total")
    return block("entry").unionByName(block("item"))


@q("json_flatten_nested", f"WITH {OBS} SELECT event_id, k, event_type AS name FROM obs")
def json_flatten(spark, sf):
    nested = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("key"), F.array(F.struct(F.col("k").alias("price"), F.lit(None).cast("string").alias("description"), F.col("event_type").alias("name"))).alias("outcomes"))).alias("markets")))
    e = observations(spark, sf).select("event_id", nested.alias("payload"))
    schema = "markets array<struct<key: string, outcomes: array<struct<price: bigint, description: string, name: string>>>>"
    m = e.select("event_id", F.explode_outer(F.from_json("payload", schema)["markets"]).alias("m"))
    o = m.select("event_id", F.explode_outer("m.outcomes").alias("o"))
    return o.select("event_id", F.col("o.price").alias("k"), F.coalesce("o.description", "o.name").alias("name"))


@q("poll_enrich", "SELECT o_orderkey, round(o_totalprice / nullif(o_custkey, 0), 9) AS fill_rate, CASE WHEN o_orderstatus = 'F' THEN round(greatest(300000 - o_totalprice, 0), 2) END AS overlay, make_timestamp(1700000000000000 + o_orderkey * 1000000) AS starts FROM orders")
def poll(spark, sf):
    text = F.concat(F.lit("/Date("), (F.lit(1700000000) + F.col("o_orderkey")).cast("string"), F.lit("000)/"))
    o = table(spark, sf, "orders").withColumn("raw", text)
    starts = F.timestamp_millis(F.regexp_extract("raw", r"\((\d+)\)", 1).cast("long"))
    return o.select("o_orderkey", r(F.try_divide("o_totalprice", "o_custkey"), 9).alias("fill_rate"), F.when(F.col("o_orderstatus") == "F", r(F.greatest(300000 - F.col("o_totalprice"), F.lit(0)), 2)).alias("overlay"), starts.alias("starts"))


@q("unpivot_periods", "SELECT c_nationkey AS k, 'w' || m AS period, count(*) AS n FROM customer, (SELECT unnest([1, 2, 3]) AS m) WHERE c_custkey % 3 = m - 1 GROUP BY 1, 2")
def unpivot(spark, sf):
    wide = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(*[F.count_if(F.col("c_custkey") % 3 == m).alias(f"w{m + 1}") for m in range(3)])
    return wide.unpivot(["k"], ["w1", "w2", "w3"], "period", "n").where("n > 0")


@q("grid_completeness", "WITH g AS (SELECT r_regionkey AS a, unnest(['A', 'N', 'R', 'X']) AS b FROM region), h AS (SELECT DISTINCT CAST(l_suppkey % 5 AS INTEGER) AS a, l_returnflag AS b FROM lineitem) SELECT a, b, 'missing' AS why FROM (SELECT * FROM g EXCEPT SELECT * FROM h) UNION ALL SELECT a, b, 'unexpected' FROM (SELECT * FROM h EXCEPT SELECT * FROM g)")
def grid(spark, sf):
    g = table(spark, sf, "region").select(F.col("r_regionkey").alias("a"), F.explode(F.array(*map(F.lit, "ANRX"))).alias("b"))
    h = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).cast("int").alias("a"), F.col("l_returnflag").alias("b")).distinct()
    side = lambda x, y, why: x.join(y, ["a", "b"], "left_anti").withColumn("why", F.lit(why))
    return side(g, h, "missing").unionByName(side(h, g, "unexpected"))


@q("latest_pull_per_group", f"WITH {OBS} SELECT event_type, event_id, value FROM obs JOIN (SELECT event_type, max(CAST(observed_at AS DATE)) AS d FROM obs GROUP BY 1) USING (event_type) WHERE CAST(observed_at AS DATE) = d")
def latest_group(spark, sf):
    o = observations(spark, sf).withColumn("d", F.to_date("observed_at"))
    newest = o.groupBy("event_type").agg(F.max("d").alias("d"))
    return o.join(newest, ["event_type", "d"]).select("event_type", "event_id", "value")


@q("latest_pull_global", f"WITH {OBS} SELECT event_id FROM obs WHERE CAST(observed_at AS DATE) = (SELECT max(CAST(observed_at AS DATE)) FROM obs)")
def latest_global(spark, sf):
    o = observations(spark, sf).withColumn("d", F.to_date("observed_at"))
    return o.join(F.broadcast(o.agg(F.max("d").alias("d"))), "d").select("event_id")


@q("latest_version_per_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark, sf):
    return W.first_row(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")
