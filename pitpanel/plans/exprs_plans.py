"""Projections, filters, scalar expressions and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import exprs as X
from pitpanel.operators import resolve as R
from pitpanel.operators import windows as W
from pitpanel.plans.bindings import FACTS, OBS, PANEL, facts, money, observations, panel, r, table

KEY = ["entity", "epoch", "period"]
QUERIES, SQL = {}, {}


def q(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@q("safe_ratio_share", "SELECT l_orderkey, l_linenumber, round((l_quantity - 1) / nullif(l_tax, 0), 6) AS ratio FROM lineitem")
def safe_ratio(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(F.try_divide(F.col("l_quantity") - 1, F.col("l_tax")), 6).alias("ratio"))


@q("safe_cast", "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS level, TRY_CAST(split_part(o_orderpriority, '-', 2) AS BIGINT) AS none FROM orders")
def safe_cast(spark, sf):
    part = lambda n: F.split_part("o_orderpriority", F.lit("-"), F.lit(n)).try_cast("long")
    return table(spark, sf, "orders").select("o_orderkey", part(1).alias("level"), part(2).alias("none"))


@q("select_except_replace", "SELECT * EXCLUDE (p_type) REPLACE (upper(p_name) AS p_name) FROM part")
def except_replace(spark, sf):
    return table(spark, sf, "part").drop("p_type").withColumn("p_name", F.upper("p_name"))


@q("code_normalize_case", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'MACH' WHEN 'HOUSEHOLD' THEN 'HOME' ELSE c_mktsegment END AS segment FROM customer")
def code_normalize(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.lookup(F.col("c_mktsegment"), {"MACHINERY": "MACH", "HOUSEHOLD": "HOME"}).alias("segment"))


@q("name_key", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(p_name || ' ' || p_brand || ' Jr.')), '\s+(JR|SR|II|III|IV|V)\.?$', ''), '[^A-Z ]', '', 'g'), ' +', ' ', 'g')) AS name_key FROM part")
def name_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.name_key(F.concat_ws(" ", "p_name", "p_brand", F.lit("Jr."))).alias("name_key"))


@q("split_index", "SELECT c_custkey, TRY_CAST(nullif(split_part(c_name, '#', 2), '') AS BIGINT) AS number, nullif(split_part(c_name, '#', 3), '') AS third FROM customer")
def split_index(spark, sf):
    at = lambda i: F.get(F.split("c_name", "#"), i)
    return table(spark, sf, "customer").select("c_custkey", at(1).try_cast("long").alias("number"), at(2).alias("third"))


@q("local_time_to_instant", f"""WITH {OBS} SELECT event_id, CAST((strftime(observed_at, '%Y-%m-%d') || ' ' || strftime(observed_at, '%H:%M:%S'))::TIMESTAMP AS TIMESTAMP) + INTERVAL 3 HOUR AS instant FROM obs WHERE hour(observed_at) >= 12""")
def local_time(spark, sf):
    text = F.concat_ws(" ", F.date_format("observed_at", "yyyy-MM-dd"), F.date_format("observed_at", "HH:mm:ss"))
    out = observations(spark, sf).where(F.hour("observed_at") >= 12)
    return out.select("event_id", F.to_utc_timestamp(F.try_to_timestamp(text), "-03:00").alias("instant"))


@q("recent_window_filter", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-03 12:00:00' - INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-03 12:00:00'")
def recent(spark, sf):
    return table(spark, sf, "events").where("ts > timestamp_ntz'2024-01-03 12:00:00' - interval 1 day AND ts <= timestamp_ntz'2024-01-03 12:00:00'").select("event_id")


@q("ts_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def ts_format(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"))


@q("bucket_case", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size FROM lineitem")
def bucket_case(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.ladder(F.col("l_quantity"), [(10, "small"), (30, "medium")], "large").alias("size"))


@q("weighted_score", "SELECT l_orderkey, l_linenumber, round(l_quantity * 0.5 + l_discount * 10 + CASE WHEN l_quantity >= 40 THEN 3 ELSE 0 END, 4) AS score FROM lineitem")
def weighted_score(spark, sf):
    score = X.weighted({"l_quantity": 0.5, "l_discount": 10}, [("l_quantity", 40, 3)])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(score).alias("score"))


@q("tiered_event_score", f"""WITH {FACTS}, g AS (SELECT grp, count(*) FILTER (flag = 'R') AS a, count(*) FILTER (flag = 'A') AS b, count(*) AS c FROM facts GROUP BY 1)
  SELECT grp, a * 2 + b + CASE WHEN c < 50 THEN 10 WHEN c < 150 THEN 5 WHEN c < 300 THEN 1 ELSE -4 END AS score FROM g""")
def tiered(spark, sf):
    g = facts(spark, sf).groupBy("grp").agg(F.count_if(F.col("flag") == "R").alias("a"), F.count_if(F.col("flag") == "A").alias("b"), F.count("*").alias("c"))
    return g.select("grp", (F.col("a") * 2 + F.col("b") + X.ladder(F.col("c"), [(50, 10), (150, 5), (300, 1)], -4)).alias("score"))


@q("null_vs_zero_gate", f"WITH {PANEL} SELECT entity, epoch, period, CASE WHEN n > 1 OR period < 7 THEN coalesce(value, 0) END AS gated FROM panel")
def null_vs_zero(spark, sf):
    return panel(spark, sf).select(*KEY, X.active_or_null((F.col("n") > 1) | (F.col("period") < 7), F.col("value")).alias("gated"))


@q("min_support_gate", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) END AS mean, CASE WHEN count(*) >= 5 THEN 'ok' ELSE 'thin' END AS reason FROM orders GROUP BY 1")
def min_support(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), money("o_totalprice").alias("s"))
    n = F.col("n")
    return g.select("o_custkey", "n", X.supported(n, 5, r(F.col("s") / n)).alias("mean"), F.when(n >= 5, "ok").otherwise("thin").alias("reason"))


@q("clip_remainder", """WITH t AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1) SELECT o_orderkey, round(CAST(greatest(s - CAST(o_totalprice AS DECIMAL(18,2)) - 300000, 0) AS DOUBLE) * CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.25 ELSE 0.1 END, 4) AS rest FROM orders JOIN t USING (o_custkey)""")
def clip_remainder(spark, sf):
    o = table(spark, sf, "orders")
    t = o.groupBy("o_custkey").agg(money("o_totalprice").alias("s"))
    rate = X.lookup(F.col("o_orderstatus"), {"F": 0.5, "O": 0.25}, F.lit(0.1))
    return o.join(t, "o_custkey").select("o_orderkey", r(X.remainder(F.col("s"), F.col("o_totalprice") + 300000, rate)).alias("rest"))


@q("canonical_row_hash", "SELECT n_nationkey, sha256('=' || n_nationkey || '|=' || n_name || '|=' || n_regionkey || '|-') AS row_hash FROM nation")
def canonical_hash(spark, sf):
    n = table(spark, sf, "nation").withColumn("none", F.lit(None).cast("string"))
    return n.select("n_nationkey", X.row_hash("n_nationkey", "n_name", "n_regionkey", "none").alias("row_hash"))


@q("hash_sample", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 20 = 0")
def hash_sample(spark, sf):
    return table(spark, sf, "orders").where(X.hash_bucket(F.col("o_custkey"), 20) == 0).select("o_orderkey", "o_custkey")


@q("inline_dim", "SELECT o_orderkey, weight FROM orders JOIN (VALUES ('F', 1.0), ('O', 0.5), ('P', 0.25)) d(s, weight) ON s = o_orderstatus")
def inline_dim(spark, sf):
    dim = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("o_orderstatus"), F.lit(w).alias("weight")) for s, w in (("F", 1.0), ("O", 0.5), ("P", 0.25))])))
    return table(spark, sf, "orders").join(F.broadcast(dim), "o_orderstatus").select("o_orderkey", "weight")


@q("unnest_columns", "SELECT DISTINCT p_partkey, alias FROM (SELECT p_partkey, p_name AS alias FROM part UNION ALL SELECT p_partkey, p_type FROM part UNION ALL SELECT p_partkey, p_brand FROM part)")
def unnest_columns(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.array("p_name", "p_type", "p_brand")).alias("alias")).distinct()


@q("skip_null_array_avg", f"WITH {PANEL} SELECT entity, epoch, period, round((coalesce(value, 0) + total + coalesce(CASE WHEN n > 2 THEN 7.0 END, 0)) / ((value IS NOT NULL)::INT + 1 + (n > 2)::INT), 4) AS mean FROM panel")
def skip_null_avg(spark, sf):
    p = panel(spark, sf).withColumn("third", F.when(F.col("n") > 2, 7.0))
    return p.select(*KEY, r(X.mean_nonnull("value", "total", "third")).alias("mean"))


@q("ordinal_encode", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 WHEN 'O' THEN 0 END AS BIGINT) AS level FROM orders")
def ordinal_encode(spark, sf):
    level = X.lookup(F.col("o_orderstatus"), {"F": 2, "P": 1, "O": 0}, F.lit(None).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", level.cast("long").alias("level"))


@q("substring_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 10")
def substring_search(spark, sf):
    return table(spark, sf, "part").where(F.lower("p_name").contains("ring")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(10)


@q("strip_markup", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


PRICE = "CASE WHEN p_size % 2 = 0 THEN 100 + p_size ELSE -(100 + p_size) END"


@q("odds_to_prob", f"""WITH a AS (SELECT p_partkey, {PRICE} AS price FROM part), b AS (SELECT p_partkey, CASE WHEN price > 0 THEN 100.0 / (price + 100) ELSE -price / (100.0 - price) END AS p FROM a)
  SELECT p_partkey, round(p, 8) AS prob, round(p / (p + 0.55), 8) AS fair FROM b""")
def odds_to_prob(spark, sf):
    p = X.implied_probability(F.expr(PRICE))
    return table(spark, sf, "part").select("p_partkey", r(p, 8).alias("prob"), r(X.devig(p, F.lit(0.55)), 8).alias("fair"))


@q("weighted_blend", f"WITH {PANEL} SELECT entity, epoch, period, round(coalesce(0.7 * total + 0.3 * value, total), 4) AS blended FROM panel")
def weighted_blend(spark, sf):
    return panel(spark, sf).select(*KEY, r(X.blend(F.col("total"), F.col("value"), 0.7)).alias("blended"))


@q("band_widen", """WITH f AS (SELECT * FROM (VALUES ('F', 1.2), ('O', 0.8)) t(s, k)) SELECT o_orderkey, round(o_totalprice - 1000 * coalesce(k, 1), 2) AS p10, round(o_totalprice + 2000 * coalesce(k, 1), 2) AS p90 FROM orders LEFT JOIN f ON s = o_orderstatus""")
def band_widen(spark, sf):
    k = X.lookup(F.col("o_orderstatus"), {"F": 1.2, "O": 0.8}, F.lit(1.0))
    x = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", r(x - 1000 * k, 2).alias("p10"), r(x + 2000 * k, 2).alias("p90"))


@q("default_fill_by_role", f"""WITH {PANEL}, prior AS (SELECT period, round(CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS d FROM panel GROUP BY 1) SELECT entity, epoch, period, coalesce(value, d) AS filled, value IS NULL AS cold FROM panel JOIN prior USING (period)""")
def default_fill(spark, sf):
    p = panel(spark, sf)
    prior = p.groupBy("period").agg(r(money("total") / F.count("*"), 2).alias("d"))  # twelve months
    return p.join(F.broadcast(prior), "period").select(*KEY, F.coalesce("value", "d").alias("filled"), F.col("value").isNull().alias("cold"))


@q("time_decay_weight", f"WITH {PANEL} SELECT entity, epoch, period, CASE WHEN epoch <= 1998 THEN round(pow(0.5, (1998 - epoch) / 2.0), 8) END AS weight FROM panel")
def time_decay(spark, sf):
    return panel(spark, sf).select(*KEY, r(X.half_life(1998 - F.col("epoch"), 2.0), 8).alias("weight"))


@q("note_multiplier", f"""WITH {OBS}, d AS (SELECT user_id, 1 + (k - 50) / 500.0 * greatest(0, 1 - abs(hour(observed_at) - 12) / 12.0) AS m FROM obs WHERE event_type = 'click')
  SELECT user_id, round(exp(sum(ln(m))), 6) AS multiplier FROM d GROUP BY 1""")
def note_multiplier(spark, sf):
    near = F.greatest(F.lit(0), 1 - F.abs(F.hour("observed_at") - 12) / 12)
    o = observations(spark, sf).where("event_type = 'click'").withColumn("m", 1 + (F.col("k") - 50) / 500 * near)
    return o.groupBy("user_id").agg(r(F.product("m"), 6).alias("multiplier"))


@q("band_cut", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN '<100k' WHEN o_totalprice < 250000 THEN '100-250k' ELSE '250k+' END AS band FROM orders")
def band_cut(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.ladder(F.col("o_totalprice"), [(100000, "<100k"), (250000, "100-250k")], "250k+").alias("band"))


@q("topk_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 20")
def topk_abs(spark, sf):
    return table(spark, sf, "customer").orderBy(F.abs(F.col("c_acctbal") - 4500).desc(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@q("topk_both_ends", """SELECT c_nationkey, c_custkey, CASE WHEN lo <= 2 THEN 'low' ELSE 'high' END AS edge FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS lo, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS hi FROM customer) WHERE lo <= 2 OR hi <= 2""")
def topk_both_ends(spark, sf):
    lo = F.row_number().over(W.ordered(["c_nationkey"], ["c_acctbal", "c_custkey"]))
    hi = F.row_number().over(W.ordered(["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]))
    out = table(spark, sf, "customer").withColumns({"lo": lo, "hi": hi}).where("lo <= 2 or hi <= 2")
    return out.select("c_nationkey", "c_custkey", F.when(F.col("lo") <= 2, "low").otherwise("high").alias("edge"))


@q("topk_entries_ties", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def topk_entries(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@q("latest_per_pair", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def latest_per_pair(spark, sf):
    newest = F.max_by(F.struct("event_id", "value"), "event_id").alias("s")
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(newest).select("user_id", "event_type", "s.event_id", "s.value")


@q("set_union_all", "SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_all(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s, allowMissingColumns=True)


@q("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@q("set_union_prefer_max", "SELECT k, max(bal) AS bal FROM (SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1")
def union_prefer_max(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return c.union(table(spark, sf, "supplier").select("s_nationkey", "s_acctbal")).groupBy("k").agg(F.max("bal").alias("bal"))


@q("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def set_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct()


@q("set_except_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))
