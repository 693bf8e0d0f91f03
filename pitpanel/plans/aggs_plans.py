"""Aggregations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.operators import aggs as G
from pitpanel.operators import ranks as K
from pitpanel.operators import windows as W
from pitpanel.plans.bindings import FACTS, GPANEL, OBS, PANEL, facts, grouped_panel, money, observations, panel, r, spread, table
from pitpanel.sources.tables import save

EP, KEY = ["epoch", "period"], ["entity", "epoch", "period"]
QUERIES, SQL = {}, {}
D = "CAST(sum(CAST({} AS DECIMAL(20,4))) AS DOUBLE)"


def q(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@q("agg_conditional_counts", f"WITH {FACTS} SELECT grp, count(*) FILTER (flag = 'R') AS returned, count(*) FILTER (status = 'O') AS open, count(*) FILTER (qty > 40 AND disc > 0.05) AS big FROM facts GROUP BY 1")
def conditional_counts(spark, sf):
    return facts(spark, sf).groupBy("grp").agg(F.count_if(F.col("flag") == "R").alias("returned"), F.count_if(F.col("status") == "O").alias("open"), F.count_if((F.col("qty") > 40) & (F.col("disc") > 0.05)).alias("big"))


@q("agg_two_level_share", f"WITH {FACTS}, m AS (SELECT grp, flag, {D.format('qty')} AS v FROM facts GROUP BY 1, 2) SELECT grp, flag, round(v / nullif(sum(v) OVER (PARTITION BY grp), 0), 8) AS share FROM m")
def two_level(spark, sf):
    return G.two_level_share(facts(spark, sf), ["grp"], "flag", money("qty"), "s").select("grp", "flag", r("s", 8).alias("share"))


@q("agg_conditional_mean", f"WITH {FACTS} SELECT grp, round({D.format('CASE WHEN disc > 0.05 THEN qty END')} / count(CASE WHEN disc > 0.05 THEN 1 END), 6) AS mean_disc FROM facts GROUP BY 1")
def conditional_mean(spark, sf):
    return facts(spark, sf).groupBy("grp").agg(r(F.avg(F.when(F.col("disc") > 0.05, F.col("qty"))), 6).alias("mean_disc"))


@q("agg_ratio_of_counts", f"WITH {FACTS} SELECT grp, round(count(*) FILTER (flag = 'R') * 1.0 / nullif(count(*) FILTER (status = 'F'), 0), 6) AS rate FROM facts GROUP BY 1")
def ratio_of_counts(spark, sf):
    return facts(spark, sf).groupBy("grp").agg(r(F.try_divide(F.count_if(F.col("flag") == "R"), F.count_if(F.col("status") == "F")), 6).alias("rate"))


@q("agg_ratio_of_conditional_sums", f"WITH {FACTS} SELECT grp, round({D.format(chr(67)+'ASE WHEN flag = ' + chr(39) + 'R' + chr(39) + ' THEN qty END')} / nullif({D.format('qty')}, 0), 6) AS rate FROM facts GROUP BY 1")
def ratio_of_sums(spark, sf):
    return facts(spark, sf).groupBy("grp").agg(r(F.try_divide(money(F.when(F.col("flag") == "R", F.col("qty"))), money("qty")), 6).alias("rate"))


@q("agg_any_value", "SELECT o_custkey, min(o_orderpriority) AS priority, count(*) AS n FROM orders GROUP BY 1")
def any_value(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("priority"), F.count("*").alias("n"))


@q("agg_max_by", "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest_price FROM orders GROUP BY 1")
def agg_max_by(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("latest_price"))


@q("agg_latest_in_array", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest_type FROM events GROUP BY 1")
def latest_in_array(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_type"))


@q("agg_first_nonnull_sorted", f"WITH {PANEL} SELECT entity, min(value) AS smallest FROM panel GROUP BY 1")
def first_nonnull(spark, sf):
    return panel(spark, sf).groupBy("entity").agg(F.min("value").alias("smallest"))


@q("agg_bool_or", f"WITH {PANEL} SELECT entity, coalesce(bool_or(value > 300000), false) AS ever FROM panel GROUP BY 1")
def agg_bool_or(spark, sf):
    return panel(spark, sf).groupBy("entity").agg(F.coalesce(F.bool_or(F.col("value") > 300000), F.lit(False)).alias("ever"))


@q("agg_distinct_conditional", f"WITH {FACTS} SELECT basket, count(DISTINCT CASE WHEN qty > 25 THEN grp END) AS n_grp, min(CASE WHEN qty > 25 THEN grp END) AS first_grp FROM facts GROUP BY 1")
def distinct_conditional(spark, sf):
    big = F.when(F.col("qty") > 25, F.col("grp"))
    return facts(spark, sf).groupBy("basket").agg(F.count_distinct(big).alias("n_grp"), F.min(big).alias("first_grp"))


@q("source_status_reconcile", f"""WITH {OBS}, s AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT value) FILTER (event_type = 'purchase') AS sold, max(value) FILTER (event_type = 'purchase') AS v, max(value) AS rebuilt FROM obs GROUP BY 1)
  SELECT user_id, CASE WHEN sold = 0 THEN 'unavailable' WHEN sold > 1 THEN 'conflict' WHEN kinds < 3 THEN 'partial' ELSE 'unique' END AS status, CASE WHEN sold = 1 THEN v ELSE rebuilt END AS chosen, round(CASE WHEN sold = 1 THEN v - rebuilt END, 4) AS delta FROM s""")
def source_status(spark, sf):
    sale = F.when(F.col("event_type") == "purchase", F.col("value"))
    s = observations(spark, sf).groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count_distinct(sale).alias("sold"), F.max(sale).alias("v"), F.max("value").alias("rebuilt"))
    one = F.col("sold") == 1
    status = F.when(F.col("sold") == 0, "unavailable").when(F.col("sold") > 1, "conflict").when(F.col("kinds") < 3, "partial").otherwise("unique")
    return s.select("user_id", status.alias("status"), F.when(one, F.col("v")).otherwise(F.col("rebuilt")).alias("chosen"), r(F.when(one, F.col("v") - F.col("rebuilt"))).alias("delta"))


@q("event_credit_union", f"""WITH {FACTS}, c AS (SELECT grp AS who, 'returned' AS kind, qty AS x FROM facts WHERE flag = 'R' UNION ALL SELECT grp, 'open', 1 FROM facts WHERE status = 'O' UNION ALL SELECT entity % 100, 'part', 0.5 FROM facts)
  SELECT who, kind, round(sum(x), 3) AS credit, count(*) AS events FROM c GROUP BY 1, 2""")
def event_credit(spark, sf):
    rows = [("returned", F.col("grp"), F.when(F.col("flag") == "R", F.col("qty"))), ("open", F.col("grp"), F.when(F.col("status") == "O", 1)), ("part", F.col("entity") % 100, F.lit(0.5))]
    return G.credits(facts(spark, sf), rows, "who").withColumn("credit", r("credit", 3))


@q("agg_stddev_samp", "SELECT o_custkey, round(stddev_samp(o_totalprice), 3) AS sd FROM orders GROUP BY 1")
def stddev(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(r(F.stddev_samp("o_totalprice"), 3).alias("sd"))


@q("agg_corr_gated", f"WITH {FACTS} SELECT grp, round(corr(CASE WHEN qty >= 5 THEN qty END, net), 6) AS corr FROM facts GROUP BY 1 HAVING count(*) > 3")
def corr_gated(spark, sf):
    return facts(spark, sf).groupBy("grp").agg(r(F.corr(F.when(F.col("qty") >= 5, F.col("qty")), "net"), 6).alias("corr"), F.count("*").alias("c")).where("c > 3").drop("c")


@q("agg_total_and_by_group", f"WITH {FACTS} SELECT coalesce(flag, 'all') AS flag, count(*) AS n, round({D.format('qty')}, 2) AS qty FROM facts GROUP BY ROLLUP (flag)")
def total_and_group(spark, sf):
    return G.total_and_by_group(facts(spark, sf), "flag", [F.count("*").alias("n"), r(money("qty"), 2).alias("qty")])


@q("agg_spearman", f"""WITH {FACTS}, k AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY qty) + (count(*) OVER (PARTITION BY grp, qty) - 1) / 2.0 AS a, rank() OVER (PARTITION BY grp ORDER BY disc) + (count(*) OVER (PARTITION BY grp, disc) - 1) / 2.0 AS b FROM facts)
  SELECT grp, round(corr(a, b), 6) AS spearman, count(*) AS n FROM k GROUP BY 1""")
def agg_spearman(spark, sf):
    f = spread(facts(spark, sf).select("grp", "qty", "disc"), table(spark, sf, "lineitem").count(), "grp")
    return G.spearman(f, ["grp"], "qty", "disc").withColumn("spearman", r("spearman", 6))


@q("agg_quantiles_group", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 3) AS q10, round(quantile_cont(o_totalprice, 0.5), 3) AS q50, round(quantile_cont(o_totalprice, 0.9), 3) AS q90 FROM orders GROUP BY 1")
def quantiles(spark, sf):
    at = {f"q{round(100 * p)}": p for p in (0.1, 0.5, 0.9)}
    found = K.quantiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", at, save)
    return found.select("o_orderpriority", *[r(c, 3).alias(c) for c in at])


@q("agg_moments_profile", f"""WITH {PANEL} SELECT entity, count(*) AS n, round({D.format('total')} / count(*), 4) AS mean, round(stddev_samp(total), 3) AS sd, round(skewness(total), 5) AS skew, round(avg((total >= 200000)::INT), 6) AS p_high, round(stddev_samp(total) / avg(total), 5) AS cv FROM panel GROUP BY 1 HAVING count(*) >= 4""")
def moments(spark, sf):
    g = panel(spark, sf).groupBy("entity").agg(F.count("*").alias("n"), r(F.avg("total")).alias("mean"), r(F.stddev_samp("total"), 3).alias("sd"), r(G.sample_skew("total"), 5).alias("skew"), r(F.avg((F.col("total") >= 200000).cast("int")), 6).alias("p_high"), r(F.stddev_samp("total") / F.avg("total"), 5).alias("cv"))
    return g.where("n >= 4")


@q("agg_weighted_mean", f"WITH {FACTS} SELECT grp, round(sum(qty * disc) / nullif(sum(qty), 0), 8) AS mean FROM facts GROUP BY 1")
def weighted_mean(spark, sf):
    return facts(spark, sf).groupBy("grp").agg(r(F.try_divide(F.sum(F.col("qty") * F.col("disc")), F.sum("qty")), 8).alias("mean"))


@q("agg_hhi", f"WITH {FACTS}, m AS (SELECT grp, flag, {D.format('qty')} AS v FROM facts GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY grp) AS sh FROM m) SELECT grp, round(sum(sh * sh), 8) AS hhi, count(*) AS members FROM s GROUP BY 1")
def agg_hhi(spark, sf):
    return G.hhi(facts(spark, sf), ["grp"], "flag", money("qty")).withColumn("hhi", r("hhi", 8))


@q("agg_nunique_grouped", f"WITH {FACTS} SELECT grp, CAST(year(day) AS BIGINT) AS epoch, count(DISTINCT entity) AS entities FROM facts GROUP BY 1, 2")
def nunique(spark, sf):
    return facts(spark, sf).groupBy("grp", F.year("day").cast("long").alias("epoch")).agg(F.count_distinct("entity").alias("entities"))


@q("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING max(o_orderdate) >= TIMESTAMP '1998-06-01'")
def having(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("m"))
    return g.where("m >= timestamp_ntz'1998-06-01'").drop("m")


@q("agg_shrunk_rate", f"""WITH {PANEL}, lg AS (SELECT epoch, period, sum(n) AS n, {D.format('total')} AS t FROM panel GROUP BY 1, 2), lp AS (SELECT epoch, period, sum(t) OVER w / nullif(sum(n) OVER w, 0) AS prior FROM lg WINDOW w AS (ORDER BY epoch, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  e AS (SELECT *, coalesce(sum(total) OVER w, 0) AS s, coalesce(sum(n) OVER w, 0) AS c FROM panel WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT entity, epoch, period, round((s + 5 * prior) / (c + 5), 3) AS rate FROM e JOIN lp USING (epoch, period)""")
def agg_shrunk(spark, sf):
    p = panel(spark, sf)
    lg = p.groupBy(*EP).agg(F.sum("n").alias("n"), money("total").alias("t"))  # a row per calendar month
    w = Window.partitionBy(F.lit(0)).orderBy(*EP).rowsBetween(Window.unboundedPreceding, -1)
    lp = lg.select(*EP, F.try_divide(F.sum("t").over(w), F.sum("n").over(w)).alias("prior"))
    e = W.trailing(p, ["entity"], EP, None, {"s": F.sum("total"), "c": F.sum("n")})
    zero = lambda c: F.coalesce(c, F.lit(0))
    return e.join(lp, EP).select(*KEY, r(G.shrunk_rate(zero("s"), zero("c"), F.col("prior"), 5), 3).alias("rate"))


OPP = """, adj AS (SELECT p.*, (grp + 1) % 25 AS opp FROM gpanel p), off AS (SELECT grp, epoch, period, {0} / count(*) AS m FROM gpanel GROUP BY 1, 2, 3),
  str AS (SELECT *, avg(m) OVER (PARTITION BY grp ORDER BY epoch, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM off)""".format(D.format("total"))


@q("agg_opponent_adjusted", f"""WITH {GPANEL}{OPP}, a AS (SELECT opp, epoch, period, m - prior AS adjusted FROM (SELECT (grp + 1) % 25 AS opp, epoch, period, m, prior FROM str))
  SELECT opp, epoch, period, round(adjusted, 3) AS adjusted, round(avg(adjusted) OVER (PARTITION BY opp ORDER BY epoch, period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 3) AS adjusted_l8 FROM a""")
def opponent_adjusted(spark, sf):
    off = grouped_panel(spark, sf).groupBy("grp", *EP).agg((money("total") / F.count("*")).alias("m"))
    st = W.trailing(off, ["grp"], EP, None, {"prior": F.avg("m")})
    a = st.select(((F.col("grp") + 1) % 25).alias("opp"), *EP, (F.col("m") - F.col("prior")).alias("adjusted"))
    return W.trailing(a, ["opp"], EP, 8, {"l8": F.avg("adjusted")}).select("opp", *EP, r("adjusted", 3).alias("adjusted"), r("l8", 3).alias("adjusted_l8"))


@q("agg_share_over_expected", f"""WITH {FACTS}, g AS (SELECT grp, count(*) AS n, count(*) FILTER (flag = 'R') * 1.0 / count(*) AS sh FROM facts GROUP BY 1), x AS (SELECT basket, avg(sh) AS expected FROM facts JOIN g USING (grp) GROUP BY 1),
  o AS (SELECT basket, count(*) AS n, count(*) FILTER (flag = 'R') * 1.0 / count(*) AS sh FROM facts GROUP BY 1)
  SELECT basket, CASE WHEN n >= 3 THEN round((sh - expected) * n / (n + 4.0), 6) END AS asoe FROM o JOIN x USING (basket)""")
def share_over_expected(spark, sf):
    rows = table(spark, sf, "lineitem").count()
    f = facts(spark, sf).select("basket", "grp", "flag")
    share = F.count_if(F.col("flag") == "R") / F.count("*")
    g = f.groupBy("grp").agg(share.alias("gs"))
    o = spread(spread(f, rows, "grp").join(g, "grp"), rows, "basket").groupBy("basket").agg(F.count("*").alias("n"), share.alias("sh"), F.avg("gs").alias("e"))
    n = F.col("n")
    return o.select("basket", F.when(n >= 3, r((F.col("sh") - F.col("e")) * n / (n + 4), 6)).alias("asoe"))


@q("agg_exposure_weight", f"WITH {FACTS}, e AS (SELECT *, qty / sum(qty) OVER (PARTITION BY basket) AS w FROM facts) SELECT basket, round(sum(w * disc), 9) AS exposure, round(max(w), 8) AS top FROM e GROUP BY 1")
def exposure(spark, sf):
    e = W.share_of_group(facts(spark, sf), ["basket"], "qty", "w")
    return e.groupBy("basket").agg(r(F.sum(F.col("w") * F.col("disc")), 9).alias("exposure"), r(F.max("w"), 8).alias("top"))


@q("agg_duplicate_counts", f"""WITH {FACTS}, b AS (SELECT basket, string_agg(flag || status, ',' ORDER BY line, flag || status) AS k FROM facts GROUP BY 1) SELECT k AS pattern, count(*) AS copies, min(basket) AS first_basket FROM b GROUP BY 1""")
def duplicate_counts(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("line", F.concat("flag", "status").alias("x"))))
    b = facts(spark, sf).groupBy("basket").agg(F.array_join(F.transform(parts, lambda s: s["x"]), ",").alias("pattern"))
    return b.groupBy("pattern").agg(F.count("*").alias("copies"), F.min("basket").alias("first_basket"))


@q("agg_counter_check", f"""WITH {FACTS}, d AS (SELECT basket, {D.format('qty')} AS s FROM facts GROUP BY 1), o AS (SELECT o_orderkey AS basket, o_totalprice FROM orders) SELECT coalesce(d.basket, o.basket) AS basket, d.basket IS NULL AS no_detail, o.basket IS NULL AS no_summary FROM d FULL JOIN o ON d.basket = o.basket WHERE d.basket IS NULL OR o.basket IS NULL OR abs(s - o_totalprice / 3000) > 50""")
def counter_check(spark, sf):
    d = facts(spark, sf).groupBy("basket").agg(money("qty").alias("s"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket"), "o_totalprice")
    both = d.join(o, "basket", "full")
    bad = F.col("s").isNull() | F.col("o_totalprice").isNull() | (F.abs(F.col("s") - F.col("o_totalprice") / 3000) > 50)
    return both.where(bad).select("basket", F.col("s").isNull().alias("no_detail"), F.col("o_totalprice").isNull().alias("no_summary"))
