"""Gates on panels built from the driver's tables: correct builds, and builds with planted faults that must be caught."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.operators import aggs as AG
from pitpanel.operators import gates as G
from pitpanel.operators import ranks as K
from pitpanel.operators import resolve as R
from pitpanel.operators import windows as W
from pitpanel.plans.bindings import FACTS, GPANEL, OBS, PANEL, facts, grouped_panel, money, observations, panel, r, table
from pitpanel.sources.tables import save

EP, KEY = ["epoch", "period"], ["entity", "epoch", "period"]
QUERIES, SQL = {}, {}
PRIOR = "avg(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"
LEAKY = "avg(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def builds(spark, sf):
    """A correct feature, and one that a third of the entities have with the current row in it."""
    p = W.trailing(panel(spark, sf), ["entity"], EP, 4, {"good": F.avg("total")})
    p = W.trailing(p, ["entity"], EP, 4, {"leaky": F.avg("total")}, inclusive=True)
    return p.withColumn("feature", F.when(F.col("entity") % 3 == 0, F.col("leaky")).otherwise(F.col("good")))


@q("gate_no_leakage", f"""WITH {PANEL}, b AS (SELECT *, {PRIOR} AS good, {LEAKY} AS leaky FROM panel)
  SELECT entity, epoch, period, round(leaky, 3) AS built, round(good, 3) AS expected FROM b WHERE entity % 3 = 0 AND coalesce(abs(leaky - good) > 1e-6, (leaky IS NULL) <> (good IS NULL))""")
def no_leakage(spark, sf):
    out = G.no_leakage(builds(spark, sf), panel(spark, sf), ["entity"], EP, "feature", "total", 4)
    return out.select(*KEY, r("built", 3).alias("built"), r("expected", 3).alias("expected"))


@q("gate_recompute_match", f"""WITH {PANEL} SELECT entity, epoch, period, 'total' AS feature, CASE WHEN entity % 7 = 0 THEN NULL ELSE total + (entity % 5 = 0)::INT END AS built,
  CASE WHEN entity % 7 <> 0 OR true THEN total END AS expected, CASE WHEN entity % 7 = 0 THEN 'null' ELSE 'value' END AS why FROM panel WHERE entity % 7 = 0 OR entity % 5 = 0""")
def recompute(spark, sf):
    p = panel(spark, sf)
    x = F.when(F.col("entity") % 7 != 0, F.col("total") + (F.col("entity") % 5 == 0).cast("int"))
    return G.recompute_match(p.withColumn("total", x), p, KEY, ["total"], 0.5)


@q("gate_first_row_null", f"""WITH {PANEL}, b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY epoch, period) AS k FROM panel) SELECT entity, epoch, period, 'feature' AS feature FROM b WHERE k = 1 AND entity % 3 = 0""")
def first_row_null(spark, sf):
    return G.first_row_null(builds(spark, sf), ["entity"], EP, ["good", "feature"])


@q("gate_source_strict_prior", f"WITH {PANEL}, s AS (SELECT *, lag(epoch * 100 + period, (entity % 4 > 0)::INT::BIGINT) OVER (PARTITION BY entity ORDER BY epoch, period) AS src FROM panel) SELECT entity, epoch, period FROM s WHERE src >= epoch * 100 + period")
def strict_prior(spark, sf):
    at = F.col("epoch") * 100 + F.col("period")
    s = panel(spark, sf).withColumn("src", F.when(F.col("entity") % 4 == 0, at).otherwise(F.lag(at).over(W.ordered(["entity"], EP))))
    return G.source_strict_prior(s, at, F.col("src")).select(*KEY)


@q("gate_universe_reconciled", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def universe(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0")
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return G.unreached(c, o, ["c_custkey"])


@q("gate_cutoff_coverage", f"""WITH {OBS}, o AS (SELECT *, CAST(observed_at AS DATE) AS day FROM obs), s AS (SELECT day, count(*) AS source_rows FROM o GROUP BY 1), c AS (SELECT day, 1 AS c FROM s WHERE dayofmonth(day) % 2 = 1), b AS (SELECT day, count(*) AS b FROM o WHERE event_type = 'error' AND hour(observed_at) < 12 GROUP BY 1)
  SELECT day, source_rows, coalesce(c, 0) AS cutoffs, coalesce(b, 0) AS built_rows FROM s LEFT JOIN c USING (day) LEFT JOIN b USING (day) WHERE coalesce(c, 0) = 0 OR coalesce(b, 0) = 0""")
def coverage(spark, sf):
    o = observations(spark, sf).withColumn("day", F.to_date("observed_at"))
    cut = o.select("day").distinct().where(F.dayofmonth("day") % 2 == 1)
    return G.cutoff_coverage(o, cut, o.where("event_type = 'error' and hour(observed_at) < 12"), "day")


@q("gate_ratio_window_reference", f"""WITH {PANEL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY epoch, period) AS k FROM panel),
  again AS (SELECT a.entity, a.epoch, a.period, sum(b.total) / nullif(sum(b.n), 0) AS x FROM o a LEFT JOIN o b ON a.entity = b.entity AND b.k BETWEEN a.k - 8 AND a.k - 1 GROUP BY 1, 2, 3),
  b AS (SELECT *, sum(total) OVER w / nullif(sum(n) OVER w, 0) AS good, sum(total) OVER v / nullif(sum(n) OVER v, 0) AS leaky FROM panel WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
  SELECT entity, count(*) AS violations FROM b JOIN again USING (entity, epoch, period) WHERE entity % 3 = 0 AND coalesce(abs(leaky - x) > 0.001, (leaky IS NULL) <> (x IS NULL)) GROUP BY 1""")
def ratio_reference(spark, sf):
    p = panel(spark, sf)
    rate = lambda inc, name: W.trailing(p, ["entity"], EP, 8, {"s": F.sum("total"), "c": F.sum("n")}, inc).select(*KEY, F.try_divide("s", "c").alias(name))
    built = rate(True, "leaky").join(rate(False, "good"), KEY).select(*KEY, F.when(F.col("entity") % 3 == 0, F.col("leaky")).otherwise(F.col("good")).alias("rate"))
    # a second plan: every row serves the next eight ordinals of its entity
    o = p.withColumn("k", F.row_number().over(W.ordered(["entity"], EP)))
    ahead = o.select("entity", "total", "n", F.explode(F.sequence(F.col("k") + 1, F.col("k") + 8)).alias("k"))
    again = o.select(*KEY, "k").join(ahead, ["entity", "k"], "left").groupBy(*KEY).agg(F.try_divide(F.sum("total"), F.sum("n")).alias("rate"))
    bad = G.recompute_match(built, again, KEY, ["rate"], 0.001)
    return bad.groupBy("entity").agg(F.count("*").alias("violations"))


@q("gate_run_all", f"""WITH {PANEL}, b AS (SELECT *, {PRIOR} AS good, {LEAKY} AS leaky FROM panel), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY epoch, period) AS k FROM panel)
  SELECT 'no_leakage' AS gate, concat_ws(':', entity, epoch, period) AS key FROM b WHERE entity % 3 = 0 AND coalesce(abs(leaky - good) > 1e-6, (leaky IS NULL) <> (good IS NULL)) UNION ALL SELECT 'first_row_null', concat_ws(':', entity, epoch, period) FROM k WHERE k = 1 AND entity % 3 = 0""")
def run_all(spark, sf):
    p = builds(spark, sf)
    kept = lambda df, gate: df.select(F.lit(gate).alias("gate"), F.concat_ws(":", *KEY).alias("key"))
    out = kept(G.no_leakage(p, panel(spark, sf), ["entity"], EP, "feature", "total", 4), "no_leakage")
    return out.unionByName(kept(G.first_row_null(p, ["entity"], EP, ["feature"]), "first_row_null"))


RULES = {"qty_positive": "qty > 0", "disc_range": "disc BETWEEN 0 AND 0.05", "net_positive": "net > 0", "flag_known": "flag IN ('A', 'N')"}


@q("gate_frame_contract", f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT coalesce({v}, false)) AS violations FROM facts" for k, v in RULES.items()))
def contract(spark, sf):
    return G.frame_contract(facts(spark, sf), {k: F.expr(v) for k, v in RULES.items()})


@q("gate_rule_suite", """SELECT 'unique_keys' AS rule, count(*) AS violations FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'orphans', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'negative', count(*) FROM customer WHERE c_acctbal < 0""")
def suite(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return G.rule_suite({"unique_keys": R.duplicates(li, ["l_orderkey", "l_partkey"]), "orphans": li.join(o, "l_orderkey", "left_anti"), "negative": table(spark, sf, "customer").where("c_acctbal < 0")})


@q("dq_missingness_census", f"""WITH {PANEL} SELECT 'value' AS feature, epoch, count(*) AS rows, count(*) - count(value) AS nulls, round(avg((value IS NULL)::INT), 6) AS null_rate, round(avg(CASE WHEN value IS NULL THEN n END), 6) AS error_null, round(avg(CASE WHEN value IS NOT NULL THEN n END), 6) AS error_present FROM panel GROUP BY epoch
  UNION ALL SELECT 'total', epoch, count(*), count(*) - count(total), round(avg((total IS NULL)::INT), 6), round(avg(CASE WHEN total IS NULL THEN n END), 6), round(avg(CASE WHEN total IS NOT NULL THEN n END), 6) FROM panel GROUP BY epoch""")
def missing(spark, sf):
    out = G.missingness(panel(spark, sf), ["value", "total"], ["epoch"], F.col("n").cast("double"))
    return out.withColumns({c: r(c, 6) for c in ("null_rate", "error_null", "error_present")})


@q("dq_support_coverage", f"WITH {GPANEL} SELECT epoch, period, round(sum(total) FILTER (grp < 10) / sum(total), 8) AS mass, count(*) FILTER (grp < 10) AS matched FROM gpanel GROUP BY 1, 2")
def support(spark, sf):
    hit = F.col("grp") < 10
    return grouped_panel(spark, sf).groupBy(*EP).agg(r(F.sum(F.when(hit, F.col("total"))) / F.sum("total"), 8).alias("mass"), F.count_if(hit).alias("matched"))


@q("dq_constrained_pick", f"""WITH {FACTS}, b AS (SELECT basket, CAST(year(min(day)) AS BIGINT) AS epoch, sum(qty) AS mass, sum(qty) FILTER (flag = 'R') AS rmass FROM facts GROUP BY 1) SELECT epoch, basket, mass FROM b WHERE mass BETWEEN 50 AND 200 AND coalesce(rmass, 0) BETWEEN 0 AND 60 QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY mass DESC, basket) = 1""")
def constrained(spark, sf):
    b = facts(spark, sf).groupBy("basket").agg(F.year(F.min("day")).cast("long").alias("epoch"), F.sum("qty").alias("mass"), F.sum(F.when(F.col("flag") == "R", F.col("qty"))).alias("rmass"))
    b = b.where(F.col("mass").between(50, 200) & F.coalesce("rmass", F.lit(0)).between(0, 60))
    return W.first_row(b, ["epoch"], [F.desc("mass"), "basket"]).select("epoch", "basket", "mass")


@q("dq_redundancy_audit", f"""WITH {FACTS}, u AS (SELECT 'qty' AS feature, grp, qty AS x, net FROM facts UNION ALL SELECT 'disc', grp, disc, net FROM facts),
  k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY net) + (count(*) OVER (PARTITION BY feature, net) - 1) / 2.0 AS b FROM u)
  SELECT feature, round(corr(x, net), 5) AS pearson, round(corr(a, b), 5) AS spearman FROM k GROUP BY 1""")
def redundancy(spark, sf):
    """net is ranked once for both features; a feature's values are ranked by how often each is there."""
    f = facts(spark, sf).select("qty", "disc", "net")
    k = K.mean_rank(f, [], "net", "b", save)
    for x in ("qty", "disc"):
        values = K.running(f.groupBy(F.col(x).alias("v")).agg(F.count("*").alias("n")), [], ["v"], {"upto": "n"}, save)
        place = F.col("upto") - (F.col("n") - 1) / 2
        k = k.join(values.select("v", place.alias(f"{x}_a")), F.col(x).eqNullSafe(F.col("v"))).drop("v")
    both = k.agg(*[c for x in ("qty", "disc") for c in (r(F.corr(x, "net"), 5).alias(x), r(F.corr(f"{x}_a", "b"), 5).alias(f"{x}_a"))])
    return both.select(F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("pearson"), F.col(f"{x}_a").alias("spearman")) for x in ("qty", "disc")])))


@q("dq_window_overlap", f"""WITH {PANEL}, a AS (SELECT entity, {'{}'} AS v FROM panel WHERE epoch <= 1996 GROUP BY 1), b AS (SELECT entity, {'{}'} AS v FROM panel WHERE epoch >= 1996 GROUP BY 1) SELECT count(*) AS common, round(corr(a.v, b.v), 5) AS corr FROM a JOIN b USING (entity)""".replace("{}", "CAST(sum(CAST(total AS DECIMAL(20,4))) AS DOUBLE) / count(*)"))
def overlap(spark, sf):
    p = panel(spark, sf)
    mean = lambda df, n: df.groupBy("entity").agg((money("total") / F.count("*")).alias(n))
    return mean(p.where("epoch <= 1996"), "a").join(mean(p.where("epoch >= 1996"), "b"), "entity").agg(F.count("*").alias("common"), r(F.corr("a", "b"), 5).alias("corr"))
