"""Graph queries: customers and suppliers as nodes, what they trade and where they live as typed edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.operators import graph as G
from pitpanel.plans.bindings import FACTS, facts, money, r, table

QUERIES, SQL = {}, {}
EDGES = f"""{FACTS}, edges AS (SELECT o_custkey AS src, l_suppkey + 1000000 AS dst, 'buys' AS kind, CAST(sum(CAST(l_quantity AS DECIMAL(20,4))) AS DOUBLE) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2
  UNION ALL SELECT c_custkey, c_nationkey + 2000000, 'lives', 1.0 FROM customer UNION ALL SELECT s_suppkey + 1000000, s_nationkey + 2000000, 'lives', 1.0 FROM supplier)"""


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def edges(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_quantity")
    buys = li.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg(money("l_quantity").alias("weight")).withColumn("kind", F.lit("buys"))
    one = lambda t, k, shift, n: table(spark, sf, t).select((F.col(k) + shift).alias("src"), (F.col(n) + 2000000).cast("long").alias("dst"), F.lit(1.0).alias("weight"), F.lit("lives").alias("kind"))
    return buys.unionByName(one("customer", "c_custkey", 0, "c_nationkey")).unionByName(one("supplier", "s_suppkey", 1000000, "s_nationkey"))


COMPETES = "competes AS (SELECT a.s_suppkey + 1000000 AS src, b.s_suppkey + 1000000 AS dst, 'competes' AS kind, 1.0 AS weight FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)"


@q("graph_build", f"WITH {EDGES}, {COMPETES} SELECT src, dst, kind, round(weight, 2) AS weight FROM edges UNION ALL SELECT src, dst, kind, weight FROM competes UNION ALL SELECT c_custkey, NULL, 'node:customer', NULL FROM customer UNION ALL SELECT s_suppkey + 1000000, NULL, 'node:supplier', NULL FROM supplier UNION ALL SELECT n_nationkey + 2000000, NULL, 'node:nation', NULL FROM nation")
def build(spark, sf):
    """Typed edges and nodes (rows without a target) in one table; suppliers of one nation compete."""
    s = table(spark, sf, "supplier").select("s_nationkey", (F.col("s_suppkey") + 1000000).alias("id"))
    competes = G.competes(s, ["s_nationkey"], "id").select("src", "dst", F.lit("competes").alias("kind"), F.lit(1.0).alias("weight"))
    out = edges(spark, sf).select("src", "dst", "kind", r("weight", 2).alias("weight")).unionByName(competes)
    for name, key, shift in (("customer", "c_custkey", 0), ("supplier", "s_suppkey", 1000000), ("nation", "n_nationkey", 2000000)):
        node = table(spark, sf, name).select((F.col(key) + shift).cast("long").alias("src"), F.lit(f"node:{name}").alias("kind"))
        out = out.unionByName(node, allowMissingColumns=True)
    return out


@q("graph_neighbors", f"WITH {EDGES} SELECT src, dst FROM edges WHERE kind = 'buys' AND src IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def neighbors(spark, sf):
    s = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    return G.neighbors(edges(spark, sf), ["buys"], s).select("src", "dst")


@q("graph_strongest_in_edge", f"WITH {EDGES} SELECT dst, arg_max(src, (weight, -src)) AS src, max(weight) AS weight FROM edges WHERE kind = 'buys' GROUP BY 1")
def strongest(spark, sf):
    return G.strongest_in_edge(edges(spark, sf), "buys")


@q("graph_news_edges", "SELECT DISTINCT user_id AS src, 2000000 + c_nationkey AS dst, 'news:' || event_type AS kind FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def news(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), "event_type")
    return e.join(table(spark, sf, "customer"), "c_custkey").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 2000000).alias("dst"), F.concat(F.lit("news:"), "event_type").alias("kind")).distinct()


@q("graph_topk_measure", f"WITH {EDGES} SELECT src, dst, weight FROM edges WHERE kind = 'buys' AND weight >= 20 ORDER BY weight DESC, src, dst LIMIT 25")
def topk(spark, sf):
    return G.neighbors(edges(spark, sf), ["buys"]).where("weight >= 20").orderBy(F.desc("weight"), "src", "dst").limit(25).select("src", "dst", "weight")


@q("graph_optional_expand", """WITH a AS (SELECT o_custkey AS customer, l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING CAST(sum(CAST(l_quantity AS DECIMAL(20,4))) AS DOUBLE) > 40), n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3)
  SELECT customer, s + 1000000 AS supplier, CAST(s_nationkey AS BIGINT) + 2000000 AS nation, n_name FROM a JOIN supplier ON s_suppkey = s LEFT JOIN n ON n_nationkey = s_nationkey""")
def expand(spark, sf):
    e = edges(spark, sf)
    a = e.where("kind = 'buys' and weight > 40").select(F.col("src").alias("customer"), F.col("dst").alias("supplier"))
    b = e.where("kind = 'lives'").select(F.col("src").alias("supplier"), F.col("dst").alias("nation"))
    n = table(spark, sf, "nation").where("n_regionkey < 3").select((F.col("n_nationkey") + 2000000).cast("long").alias("nation"), "n_name")
    return a.join(b, "supplier").join(F.broadcast(n), "nation", "left").select("customer", "supplier", "nation", "n_name")


MEASURES = f"{FACTS}, m AS (SELECT grp, flag, CAST(sum(CAST(qty AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS v FROM facts GROUP BY 1, 2)"


def measures(spark, sf):
    return facts(spark, sf).groupBy("grp", "flag").agg((money("qty") / F.count("*")).alias("v"))


@q("graph_paired_delta", f"WITH {MEASURES}, d AS (SELECT grp, max(v) FILTER (flag = 'A') AS o, max(v) FILTER (flag = 'N') AS n FROM m GROUP BY 1), e AS (SELECT *, n - o AS delta FROM d WHERE n IS NOT NULL AND o IS NOT NULL) SELECT count(*) AS tasks, round(avg(delta), 6) AS mean, round(stddev_pop(delta), 6) AS sd, count(*) FILTER (delta > 0) AS better, count(*) FILTER (delta = 0) AS tied, array_to_string(list_sort(list(grp) FILTER (delta < 0)), ',') AS regressions FROM e")
def paired(spark, sf):
    d = G.paired_delta(measures(spark, sf), ["grp"], "flag", "v", "A", "N")
    n = lambda e: F.count_if(F.expr(e))
    return d.agg(F.count("*").alias("tasks"), r(F.avg("delta"), 6).alias("mean"), r(F.stddev_pop("delta"), 6).alias("sd"), n("delta > 0").alias("better"), n("delta = 0").alias("tied"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("delta") < 0, F.col("grp")))), ",").alias("regressions"))


@q("graph_coverage_counts", f"WITH {MEASURES} SELECT flag, count(DISTINCT grp) AS tasks, array_to_string(list_sort(list(DISTINCT grp)), ',') AS task_ids FROM m GROUP BY 1")
def coverage(spark, sf):
    return measures(spark, sf).groupBy("flag").agg(F.count_distinct("grp").alias("tasks"), F.array_join(F.array_sort(F.collect_set("grp")), ",").alias("task_ids"))


@q("graph_metric_ranking", f"WITH {MEASURES}, a AS (SELECT flag, round(avg(v), 6) AS mean FROM m GROUP BY 1) SELECT flag, mean, row_number() OVER (ORDER BY mean DESC, flag) AS place FROM a")
def ranking(spark, sf):
    from pyspark.sql import Window

    a = measures(spark, sf).groupBy("flag").agg(r(F.avg("v"), 6).alias("mean"))  # a row per flag
    return a.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "flag")).cast("long"))


@q("graph_evidence_lookups", f"""WITH e0 AS MATERIALIZED (WITH {EDGES} SELECT * FROM edges), b AS (SELECT * FROM e0 WHERE kind = 'buys'), l AS (SELECT * FROM e0 WHERE kind = 'lives')
  SELECT 'bought' AS lookup, src, dst AS hop1, NULL AS hop2 FROM b WHERE weight > 40 UNION ALL SELECT 'home', src, dst, NULL FROM l UNION ALL SELECT 'neighbours', dst, src, NULL FROM l UNION ALL SELECT 'bought_from', b.src, b.dst, l.dst FROM b JOIN l ON l.src = b.dst WHERE b.weight > 40""")
def lookups(spark, sf):
    """Four typed lookups in one table: what was bought, where one lives, who lives there, and where from by two hops."""
    e = edges(spark, sf)
    buys, lives = e.where("kind = 'buys' and weight > 40"), e.where("kind = 'lives'")
    told = lambda df, name, a, b: df.select(F.lit(name).alias("lookup"), F.col(a).alias("src"), F.col(b).alias("hop1"), F.lit(None).cast("long").alias("hop2"))
    home = lives.select(F.col("src").alias("hop1"), F.col("dst").alias("hop2"))
    two = buys.select(F.lit("bought_from").alias("lookup"), "src", F.col("dst").alias("hop1")).join(home, "hop1")
    return told(buys, "bought", "src", "dst").unionByName(told(lives, "home", "src", "dst")).unionByName(told(lives, "neighbours", "dst", "src")).unionByName(two.select("lookup", "src", "hop1", "hop2"))


@q("graph_compatibility", "WITH a AS (SELECT p_partkey AS k, unnest(['brand', 'type', 'size']) AS field, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS v FROM part), b AS (SELECT k + 1 AS k, field, v FROM a) SELECT a.k, field, a.v AS own, b.v AS other FROM a JOIN b USING (k, field) WHERE a.v IS DISTINCT FROM b.v")
def compatibility(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
    a = p.unpivot(["k"], ["brand", "type", "size"], "field", "own")
    b = a.select((F.col("k") + 1).alias("k"), "field", F.col("own").alias("other"))
    return a.join(b, ["k", "field"]).where(~F.col("own").eqNullSafe(F.col("other")))
