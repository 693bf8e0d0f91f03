"""Monitoring and evaluation: order values against their customer's strictly prior means."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.operators import evaluate as V
from pitpanel.operators import ranks as K
from pitpanel.operators import windows as W
from pitpanel.operators.regress import walk_forward_ridge
from pitpanel.plans.bindings import FACTS, GPANEL, PANEL, facts, grouped_panel, panel, r, table
from pitpanel.sources.tables import save

EP, KEY = ["epoch", "period"], ["entity", "epoch", "period"]
QUERIES, SQL = {}, {}
FC = f"""{GPANEL}, fc AS (SELECT * FROM (SELECT entity, epoch, period, grp, n, round(total, 2) AS y, round(avg(total) OVER w, 2) AS pred, round(min(total) OVER w, 2) AS p10, round(max(total) OVER w, 2) AS p90,
  round(last_value(total) OVER w, 2) AS market FROM gpanel WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) WHERE pred IS NOT NULL)"""


PRICED = "priced AS (SELECT entity, epoch, period, grp, y / 1e5 AS v, pred / 1e5 AS x1, market / 1e5 AS x2, (p90 - p10) / 1e5 AS x3 FROM fc)"


def fc(spark, sf):
    aggs = {"pred": F.avg("total"), "p10": F.min("total"), "p90": F.max("total"), "market": F.last("total")}
    out = W.trailing(grouped_panel(spark, sf), ["entity"], EP, 6, aggs).where("pred is not null")
    return out.select(*KEY, "grp", "n", r("total", 2).alias("y"), *[r(c, 2).alias(c) for c in aggs])


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@q("mon_psi", f"""WITH {FACTS}, b AS (SELECT qty FROM facts WHERE flag = 'A'), v AS (SELECT qty FROM facts WHERE flag <> 'A'), cuts AS (SELECT quantile_cont(qty, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS c FROM b),
  bb AS (SELECT len(list_filter(c, lambda x: x < qty)) AS bin, count(*) AS n FROM b, cuts GROUP BY 1), vv AS (SELECT len(list_filter(c, lambda x: x < qty)) AS bin, count(*) AS n FROM v, cuts GROUP BY 1),
  s AS (SELECT greatest(coalesce(bb.n, 0) * 1.0 / (SELECT sum(n) FROM bb), 1e-6) AS p, greatest(coalesce(vv.n, 0) * 1.0 / (SELECT sum(n) FROM vv), 1e-6) AS w FROM bb FULL JOIN vv USING (bin)) SELECT round(sum((w - p) * ln(w / p)), 8) AS psi FROM s""")
def mon_psi(spark, sf):
    f = facts(spark, sf)
    return V.psi(f.where("flag = 'A'"), f.where("flag <> 'A'"), "qty", 10, save).select(r("psi", 8).alias("psi"))


@q("mon_null_rate", f"WITH {PANEL}, s AS (SELECT avg((value IS NULL)::INT) FILTER (epoch < 1997) AS base, avg((value IS NULL)::INT) FILTER (epoch >= 1997) AS live FROM panel) SELECT round(base, 8) AS base, round(live, 8) AS live, live > 2 * greatest(base, 0.01) AS drifted FROM s")
def mon_null(spark, sf):
    gone = F.col("value").isNull().cast("int")
    s = panel(spark, sf).agg(F.avg(F.when(F.col("epoch") < 1997, gone)).alias("base"), F.avg(F.when(F.col("epoch") >= 1997, gone)).alias("live"))
    return s.select(r("base", 8).alias("base"), r("live", 8).alias("live"), (F.col("live") > 2 * F.greatest("base", F.lit(0.01))).alias("drifted"))


@q("mon_coverage", f"WITH {FC} SELECT epoch, round(avg((y < p10)::INT), 8) AS below, round(avg((y < p90)::INT), 8) AS under, avg((y < p10)::INT) BETWEEN 0.05 AND 0.3 AS ok FROM fc GROUP BY 1")
def mon_coverage(spark, sf):
    b = F.avg((F.col("y") < F.col("p10")).cast("int"))
    return fc(spark, sf).groupBy("epoch").agg(r(b, 8).alias("below"), r(F.avg((F.col("y") < F.col("p90")).cast("int")), 8).alias("under"), b.between(0.05, 0.3).alias("ok"))


@q("mon_mae_ratio", f"WITH {FC}, s AS (SELECT avg(abs(y - pred)) FILTER (epoch < 1997) AS a, avg(abs(y - pred)) FILTER (epoch >= 1997) AS b FROM fc) SELECT round(b / a, 8) AS ratio, b / a > 1.3 AS alert FROM s")
def mon_mae(spark, sf):
    e = F.abs(F.col("y") - F.col("pred"))
    s = fc(spark, sf).agg(F.avg(F.when(F.col("epoch") < 1997, e)).alias("a"), F.avg(F.when(F.col("epoch") >= 1997, e)).alias("b"))
    return s.select(r(F.col("b") / F.col("a"), 8).alias("ratio"), (F.col("b") / F.col("a") > 1.3).alias("alert"))


@q("eval_point", f"WITH {FC} SELECT grp, count(*) AS n, round(avg(abs(y - pred)), 1) AS mae, round(avg(abs(y - market)), 1) AS market_mae, avg(abs(y - pred)) < avg(abs(y - market)) AS beats, round(avg((y BETWEEN p10 AND p90)::INT), 8) AS coverage FROM fc GROUP BY 1")
def eval_point(spark, sf):
    y = F.col("y")
    a, b = F.avg(F.abs(y - F.col("pred"))), F.avg(F.abs(y - F.col("market")))
    return fc(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), r(a, 1).alias("mae"), r(b, 1).alias("market_mae"), (a < b).alias("beats"), r(F.avg(y.between(F.col("p10"), F.col("p90")).cast("int")), 8).alias("coverage"))


@q("eval_accuracy_report", f"WITH {FC} SELECT coalesce(CAST(epoch AS VARCHAR), 'all') AS epoch, count(*) AS n, round(avg(abs(y - pred)), 1) AS mae, round(avg(abs(y - market)), 1) AS naive FROM fc GROUP BY ROLLUP (epoch) HAVING count(*) >= 20")
def accuracy_report(spark, sf):
    from pitpanel.operators.aggs import total_and_by_group

    rows = fc(spark, sf).withColumn("epoch", F.col("epoch").cast("string"))
    out = total_and_by_group(rows, "epoch", [F.count("*").alias("n"), r(F.avg(F.abs(F.col("y") - F.col("pred"))), 1).alias("mae"), r(F.avg(F.abs(F.col("y") - F.col("market"))), 1).alias("naive")])
    return out.where("n >= 20")


@q("eval_calibration_table", f"WITH {FC} SELECT quantile, round(avg((y < v)::INT), 8) AS below FROM (SELECT y, 'p10' AS quantile, p10 AS v FROM fc UNION ALL SELECT y, 'p50', pred FROM fc UNION ALL SELECT y, 'p90', p90 FROM fc) GROUP BY 1")
def calibration_table(spark, sf):
    long = fc(spark, sf).select("y", F.col("p10"), F.col("pred").alias("p50"), "p90").unpivot(["y"], ["p10", "p50", "p90"], "quantile", "v")
    return long.groupBy("quantile").agg(r(F.avg((F.col("y") < F.col("v")).cast("int")), 8).alias("below"))


@q("eval_strata_calibration", f"""WITH {FC}, l AS (SELECT 'epoch' AS dimension, CAST(epoch AS VARCHAR) AS label, * FROM fc UNION ALL SELECT 'grp', CAST(grp AS VARCHAR), * FROM fc UNION ALL SELECT 'busy', CAST(n > 1 AS VARCHAR), * FROM fc)
  SELECT dimension, label, count(*) AS rows, round(avg(abs(y - pred)), 1) AS mae, round(sqrt(avg(pow(y - pred, 2))), 3) AS rmse, round(avg((y BETWEEN p10 AND p90)::INT), 8) AS coverage FROM l GROUP BY 1, 2""")
def strata_calibration(spark, sf):
    d = F.col("y") - F.col("pred")
    aggs = [F.count("*").alias("rows"), r(F.avg(F.abs(d)), 1).alias("mae"), r(F.sqrt(F.avg(d * d)), 3).alias("rmse"), r(F.avg(F.col("y").between(F.col("p10"), F.col("p90")).cast("int")), 8).alias("coverage")]
    return V.strata(fc(spark, sf), {"epoch": F.col("epoch"), "grp": F.col("grp"), "busy": F.col("n") > 1}, aggs)


@q("eval_sample_scores", f"""WITH {FACTS}, a AS (SELECT basket, CAST(sum(CAST(qty AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS mean, (CAST(sum(CAST(qty AS DECIMAL(20,4))) AS DOUBLE) / count(*) + max(qty)) / 2 AS y, {", ".join(f"quantile_cont(qty, 0.{q}) AS q{q}" for q in (90, 99))} FROM facts GROUP BY 1), k AS (SELECT a.*, qty, row_number() OVER (PARTITION BY basket ORDER BY qty) AS k, count(*) OVER (PARTITION BY basket) AS n FROM facts JOIN a USING (basket))
  SELECT basket, round(max(mean - y), 6) + 0.0 AS bias, round(avg(abs(qty - y)) - sum((2 * k - n - 1) * qty) / max(n * n), 6) AS crps, {", ".join(f"round(pow(avg((qty >= {t})::INT) - max((y >= {t})::INT), 2), 6) AS brier_{t}" for t in (20, 30))},
    {", ".join(f"max(y) > max(q{q}) AS exceeds_q{q}, round(greatest(0.{q} * max(y - q{q}), (0.{q} - 1) * max(y - q{q})), 6) AS pinball_q{q}" for q in (90, 99))} FROM k GROUP BY 1""")
def sample_scores(spark, sf):
    """A basket's quantities as a sample of forecasts; the actual value is midway between their mean and the largest."""
    f = facts(spark, sf)
    at = {"q90": 0.9, "q99": 0.99}
    a = f.groupBy("basket").agg(F.avg("qty").alias("mean"), F.max("qty").alias("top"), F.sort_array(F.collect_list("qty")).alias("sample"), *[F.avg((F.col("qty") >= t).cast("int")).alias(f"p{t}") for t in (20, 30)])
    a = a.withColumn("y", (F.col("mean") + F.col("top")) / 2).withColumns({c: V.sample_quantile(F.col("sample"), x) for c, x in at.items()}).drop("sample")
    crps = V.sample_crps(f.join(a.select("basket", "y"), "basket"), ["basket"], "qty", "y").join(a, "basket")
    brier = [V.rounded(F.pow(F.col(f"p{t}") - (F.col("y") >= t).cast("int"), 2), 6).alias(f"brier_{t}") for t in (20, 30)]
    tails = [x for c, q in at.items() for x in ((F.col("y") > F.col(c)).alias(f"exceeds_{c}"), V.rounded(V.pinball(F.col("y"), F.col(c), q), 6).alias(f"pinball_{c}"))]
    return crps.select("basket", (V.rounded(F.col("mean") - F.col("y"), 6) + F.lit(0.0)).alias("bias"), V.rounded(F.col("crps"), 6).alias("crps"), *brier, *tails)


@q("eval_cluster_se", f"""WITH {FC}, e AS (SELECT epoch, period, y - pred AS d FROM fc), m AS (SELECT avg(d) AS m, count(*) AS n FROM e), c AS (SELECT sum(d) - count(*) * max(m) AS s FROM e, m GROUP BY epoch, period)
  SELECT round((SELECT m FROM m), 2) AS mean, round(sqrt(sum(s * s) * count(*) / (count(*) - 1)) / (SELECT n FROM m), 3) AS se, count(*) AS clusters FROM c""")
def cluster_se(spark, sf):
    e = fc(spark, sf).select(*EP, (F.col("y") - F.col("pred")).alias("d"))
    return V.cluster_se(e, EP, "d").select(r("mean", 2).alias("mean"), r("se", 3).alias("se"), "clusters")


@q("eval_pinball_by_stratum", f"WITH {FC} SELECT epoch, round(avg(greatest(0.9 * (y - p90), -0.1 * (y - p90))), 3) AS own, round(avg(greatest(0.9 * (y - market), -0.1 * (y - market))), 3) AS market FROM fc GROUP BY 1")
def pinball_stratum(spark, sf):
    y = F.col("y")
    return fc(spark, sf).groupBy("epoch").agg(r(F.avg(V.pinball(y, F.col("p90"), 0.9)), 3).alias("own"), r(F.avg(V.pinball(y, F.col("market"), 0.9)), 3).alias("market"))


@q("eval_disagreement_tails", f"""WITH {FC}, g AS (SELECT *, pred - market AS gap FROM fc), c AS (SELECT quantile_cont(gap, 0.2) AS lo, quantile_cont(gap, 0.8) AS hi FROM g) SELECT CASE WHEN gap <= lo THEN 'low' ELSE 'high' END AS tail, count(*) AS n, round(avg(y - pred), 2) AS miss FROM g, c WHERE gap <= lo OR gap >= hi GROUP BY 1""")
def disagreement(spark, sf):
    g = fc(spark, sf).withColumn("gap", F.col("pred") - F.col("market"))
    c = K.quantiles(g, [], "gap", {"lo": 0.2, "hi": 0.8}, save)
    g = g.crossJoin(F.broadcast(c)).where("gap <= lo or gap >= hi")
    return g.groupBy(F.when(F.col("gap") <= F.col("lo"), "low").otherwise("high").alias("tail")).agg(F.count("*").alias("n"), r(F.avg(F.col("y") - F.col("pred")), 2).alias("miss"))


@q("eval_rank_quality", f"""WITH {FC}, h AS (SELECT epoch, entity, period, pred, (y > 250000)::INT AS hit, row_number() OVER (PARTITION BY epoch ORDER BY pred DESC, entity * 100 + period) AS k FROM fc),
  i AS (SELECT *, sum(hit) OVER (PARTITION BY epoch ORDER BY k ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER (PARTITION BY epoch ORDER BY hit DESC, entity * 100 + period) AS b FROM h)
  SELECT epoch, round(sum(hit * hits * 1.0 / k) / nullif(sum(hit), 0), 8) AS ap, round(sum(hit / log2(k + 1)) / nullif(sum(hit / log2(b + 1)), 0), 8) AS ndcg FROM i GROUP BY 1""")
def rank_quality(spark, sf):
    h = fc(spark, sf).withColumns({"hit": (F.col("y") > 250000).cast("int"), "tie": F.col("entity") * 100 + F.col("period")})
    return K.rank_quality(h.select("epoch", "pred", "tie", "hit"), ["epoch"], "pred", ["tie"], "hit", save).select("epoch", r("ap", 8).alias("ap"), r("ndcg", 8).alias("ndcg"))


@q("eval_matched_report", f"WITH {FC} SELECT count(*) AS pairs, round(avg(y - market), 2) AS mean_delta, round(quantile_cont(y - market, 0.5), 2) AS median_delta, round(avg((y > 300000)::INT), 8) AS treated_tail, round(avg((market > 300000)::INT), 8) AS control_tail FROM fc")
def matched_report(spark, sf):
    f = fc(spark, sf).withColumn("d", F.col("y") - F.col("market"))
    tail = lambda c: r(F.avg((F.col(c) > 300000).cast("int")), 8)
    out = f.agg(F.count("*").alias("pairs"), r(F.avg("d"), 2).alias("mean_delta"), tail("y").alias("treated_tail"), tail("market").alias("control_tail"))
    return out.crossJoin(K.quantiles(f, [], "d", {"q": 0.5}, save).select(r("q", 2).alias("median_delta")))


@q("eval_paired_panel", f"WITH {FC} SELECT epoch, period, max(y) AS pool_best, max(CASE WHEN pred > 200000 THEN y END) AS picked_best, count(*) FILTER (y > 300000) AS clears FROM fc GROUP BY 1, 2")
def paired_panel(spark, sf):
    return fc(spark, sf).groupBy(*EP).agg(F.max("y").alias("pool_best"), F.max(F.when(F.col("pred") > 200000, F.col("y"))).alias("picked_best"), F.count_if(F.col("y") > 300000).alias("clears"))


@q("eval_paired_discordance", f"WITH {FC}, d AS (SELECT epoch, abs(y - pred) AS a, abs(y - market) AS b FROM fc) SELECT epoch, count(*) FILTER (a < b) AS better, count(*) FILTER (a > b) AS worse, count(*) FILTER (a = b) AS tied, count(*) FILTER (a < 50000 AND b >= 50000) AS only_a, count(*) FILTER (b < 50000 AND a >= 50000) AS only_b FROM d GROUP BY 1")
def discordance(spark, sf):
    d = fc(spark, sf).select("epoch", F.abs(F.col("y") - F.col("pred")).alias("a"), F.abs(F.col("y") - F.col("market")).alias("b"))
    n = F.count_if
    return d.groupBy("epoch").agg(*[n(F.expr(e)).alias(k) for k, e in {"better": "a < b", "worse": "a > b", "tied": "a = b", "only_a": "a < 50000 and b >= 50000", "only_b": "b < 50000 and a >= 50000"}.items()])


_STEPS = [(0.36788, 0), (0.73576, 1), (0.91970, 2), (0.98101, 3), (0.99634, 4)]  # fixed values: Poisson(1)


@q("eval_paired_bootstrap", f"""WITH {FC}, d AS (SELECT epoch, period, sum(abs(y - pred) - abs(y - market)) AS s, count(*) AS c FROM fc GROUP BY 1, 2), w AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', epoch, period, rep)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM d, (SELECT unnest(range(1, 201)) AS rep)), p AS (SELECT *, CASE {" ".join(f"WHEN u < {b} THEN {k}" for b, k in _STEPS)} ELSE 5 END AS w FROM w), b AS (SELECT rep, sum(w * s) / nullif(sum(w * c), 0) AS diff FROM p GROUP BY 1)
  SELECT round(avg(diff), 4) AS mean, round(quantile_cont(diff, 0.025), 4) AS low, round(quantile_cont(diff, 0.975), 4) AS high FROM b""")
def bootstrap(spark, sf):
    """Poisson weights per (cluster, replicate) from a hash; clusters are summed first, so a replicate costs a row per cluster."""
    d = fc(spark, sf).groupBy(*EP).agg(F.sum(F.abs(F.col("y") - F.col("pred")) - F.abs(F.col("y") - F.col("market"))).alias("s"), F.count("*").alias("c"))
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(200))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *EP, "rep")), 1, 8), 16, 10).cast("long") / 4294967296
    weight = F.lit(5)
    for bound, k in reversed(_STEPS):
        weight = F.when(u < bound, k).otherwise(weight)
    by = d.withColumn("w", weight).groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("c"))).alias("diff"))
    return by.agg(r(F.avg("diff")).alias("mean"), r(F.percentile("diff", F.lit(0.025))).alias("low"), r(F.percentile("diff", F.lit(0.975))).alias("high"))


GRID = [round(0.5 + 0.1 * i, 1) for i in range(11)]


@q("fit_widen_grid", f"""WITH {FC}, g AS (SELECT epoch, x AS g, abs(avg((y BETWEEN pred - x * (pred - p10) AND pred + x * (p90 - pred))::INT) - 0.8) AS l FROM fc, (SELECT unnest({GRID}) AS x) GROUP BY 1, 2) SELECT epoch, CAST(arg_min(g, (round(l, 9), g)) AS DOUBLE) AS best, round(min(l), 8) AS loss FROM g GROUP BY 1""")
def widen(spark, sf):
    p, g = F.col("pred"), F.col("g")
    inside = F.col("y").between(p - g * (p - F.col("p10")), p + g * (F.col("p90") - p))
    return V.grid_best(fc(spark, sf), ["epoch"], GRID, F.abs(F.avg(inside.cast("int")) - 0.8)).withColumn("loss", r("loss", 8))


@q("fit_blend_weight", f"WITH {FC} SELECT grp, round(greatest(0, least(1, sum((pred - market) * (y - market)) / nullif(sum(pow(pred - market, 2)), 0))), 6) AS weight FROM fc GROUP BY 1")
def blend_weight(spark, sf):
    return fc(spark, sf).groupBy("grp").agg(r(V.blend_weight(F.col("y"), F.col("pred"), F.col("market")), 6).alias("weight"))


@q("fit_sigma_scale", f"""WITH {FC}, z AS (SELECT epoch, period, (y - pred) / ((p90 - p10) / 2.5632) AS z FROM fc WHERE p90 > p10), t AS (SELECT DISTINCT epoch, period FROM fc), b AS (SELECT t.epoch, t.period, count(z) AS n, quantile_cont(z, 0.9) AS q FROM t LEFT JOIN z ON z.epoch = t.epoch AND z.period BETWEEN t.period - 3 AND t.period - 1 GROUP BY 1, 2)
  SELECT epoch, period, n, CASE WHEN n < 100 THEN 1.0 ELSE round(greatest(0.6, least(1.8, q / 1.2816)), 6) END AS scale FROM b""")
def sigma_scale(spark, sf):
    """For every month: the scale that the three months before it in its year call for; 1 with under 100 rows.

    A row serves the three months after its own, so months meet by equality.
    """
    f = fc(spark, sf)
    asked = f.select("epoch", "period").distinct()  # a row per month
    z = f.where("p90 > p10").select("epoch", F.explode(F.sequence(F.col("period") + 1, F.col("period") + 3)).alias("period"), ((F.col("y") - F.col("pred")) / ((F.col("p90") - F.col("p10")) / 2.5632)).alias("z"))
    z = save(z)
    q90 = K.quantiles(z, ["epoch", "period"], "z", {"q": 0.9}, save)
    n = z.groupBy("epoch", "period").agg(F.count("*").alias("n"))
    out = asked.join(n, ["epoch", "period"], "left").join(q90, ["epoch", "period"], "left")
    scale = F.when(F.col("n") >= 100, r(F.greatest(F.lit(0.6), F.least(F.lit(1.8), F.col("q") / 1.2816)), 6)).otherwise(1.0)
    return out.select("epoch", "period", F.coalesce("n", F.lit(0)).alias("n"), scale.alias("scale"))


@q("fit_walk_forward_folds", f"WITH {PANEL}, e AS (SELECT DISTINCT epoch FROM panel) SELECT a.epoch AS held, b.epoch AS train FROM e a JOIN e b ON b.epoch < a.epoch WHERE a.epoch >= (SELECT min(epoch) + 2 FROM e)")
def folds(spark, sf):
    e = panel(spark, sf).select("epoch").distinct()  # a row per year
    low = e.agg((F.min("epoch") + 2).alias("low"))
    held = e.crossJoin(F.broadcast(low)).where("epoch >= low").select(F.col("epoch").alias("held"))
    return held.join(F.broadcast(e.withColumnRenamed("epoch", "train")), F.col("train") < F.col("held"))


# of every nation and year: sums over earlier years, the ridge of three features by Cramer's rule
_DET = "({a}11 * ({a}22 * {a}33 - {a}23 * {a}23) - {a}12 * ({a}12 * {a}33 - {a}23 * {a}13) + {a}13 * ({a}12 * {a}23 - {a}22 * {a}13))"
_SUMS = {f"s{i}": f"x{i}" for i in (1, 2, 3)} | {"sy": "v"} | {f"s{i}{j}": f"x{i} * x{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j} | {f"t{i}": f"x{i} * v" for i in (1, 2, 3)}


@q("fit_pricing_residual", f"""WITH {FC}, {PRICED}, e AS (SELECT grp, epoch, count(*) AS n, {", ".join(f"sum({x}) AS {c}" for c, x in _SUMS.items())} FROM priced GROUP BY 1, 2),
  p AS (SELECT grp, epoch, sum(n) OVER w AS n, {", ".join(f"sum({c}) OVER w AS {c}" for c in _SUMS)} FROM e WINDOW w AS (PARTITION BY grp ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  m AS (SELECT *, {", ".join(f"s{i} / n AS m{i}, sqrt(s{i}{i} / n - s{i} / n * s{i} / n) AS d{i}" for i in (1, 2, 3))} FROM p WHERE n >= 20 AND epoch IN (SELECT epoch FROM (SELECT DISTINCT epoch FROM priced) ORDER BY epoch OFFSET 3)),
  c AS (SELECT *, {", ".join(f"(s{i}{j} - n * m{i} * m{j}) / d{i} / d{j}{' + 5' * (i == j)} AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)}, {", ".join(f"(t{i} - m{i} * sy) / d{i} AS b{i}" for i in (1, 2, 3))} FROM m),
  g AS (SELECT *, {_DET.format(a="a")} AS det FROM c),
  f AS (SELECT grp, epoch, sy / n AS b0, {", ".join(f"m{i}, d{i}" for i in (1, 2, 3))},
    (b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / det AS w1,
    (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / det AS w2,
    (a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / det AS w3 FROM g),
  r AS (SELECT entity, epoch, period, grp, v - (b0 + {" + ".join(f"w{i} * (x{i} - m{i}) / d{i}" for i in (1, 2, 3))}) AS residual FROM priced JOIN f USING (grp, epoch)),
  z AS (SELECT *, coalesce(residual / nullif(stddev_pop(residual) OVER (PARTITION BY grp, epoch), 0), 0) AS z FROM r)
  SELECT entity, epoch, period, round(residual, 3) + 0.0 AS residual, round(z, 3) + 0.0 AS residual_z, z <= -1.5 AS watchlist FROM z""")
def pricing(spark, sf):
    """Order value on what the customer's earlier months say, by nation, every year from the years before it."""
    f = fc(spark, sf).select(*KEY, "grp", (F.col("y") / 1e5).alias("v"), (F.col("pred") / 1e5).alias("x1"), (F.col("market") / 1e5).alias("x2"), ((F.col("p90") - F.col("p10")) / 1e5).alias("x3"))
    out = walk_forward_ridge(f, ["grp"], "epoch", ["x1", "x2", "x3"], "v", min_epochs=3)
    return out.select(*KEY, *[(r(c, 3) + F.lit(0.0)).alias(c) for c in ("residual", "residual_z")], "watchlist")


@q("fit_conformal_quantile", f"""WITH {FC}, k AS (SELECT grp, greatest(p10 - y, y - p90) AS s, row_number() OVER (PARTITION BY grp ORDER BY greatest(p10 - y, y - p90)) AS k, count(*) OVER (PARTITION BY grp) AS n FROM fc), a AS (SELECT grp, max(s) FILTER (k = ceil((n + 1) * 0.8)) AS q, count(*) AS n FROM k GROUP BY 1)
  SELECT grp, CASE WHEN n >= 20 THEN q ELSE (SELECT max(s) FILTER (k = ceil((n + 1) * 0.8)) FROM (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM k)) END AS q, n FROM a""")
def conformal(spark, sf):
    s = fc(spark, sf).select("grp", F.greatest(F.col("p10") - F.col("y"), F.col("y") - F.col("p90")).alias("s"))
    own = V.conformal_quantile(s, ["grp"], "s", 0.8)
    # the fallback over all rows: the order statistic by counting values, not by one sorted partition
    n = s.agg(F.count("*").alias("n"))
    every = _order_statistic(s, n)
    return own.crossJoin(F.broadcast(every)).select("grp", F.when(F.col("n") >= 20, F.col("q")).otherwise(F.col("all")).alias("q"), "n")


def _order_statistic(s, n):
    by = s.groupBy("s").agg(F.count("*").alias("c"))
    # ranges of values sorted apart, their sizes summed on top: no partition holds all values
    parts = save(by.repartitionByRange("s").withColumn("part", F.spark_partition_id()))  # written: the cuts are made once
    sizes = parts.groupBy("part").agg(F.sum("c").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("s"))
    ranked = parts.join(F.broadcast(before), "part").withColumn("upto", upto)
    return ranked.crossJoin(F.broadcast(n)).where(F.col("upto") >= F.ceil((F.col("n") + 1) * 0.8)).agg(F.min("s").alias("all"))


@q("fit_risk_control", f"""WITH {FC}, l AS (SELECT CAST(x AS DOUBLE) AS knob, avg((y > pred * x)::INT) AS risk, count(*) AS n FROM fc, (SELECT unnest({GRID}) AS x) GROUP BY 1), b AS (SELECT *, (n * risk + 1) / (n + 1) AS bound FROM l), k AS (SELECT coalesce(min(knob) FILTER (bound <= 0.35), max(knob)) AS knob, count(*) FILTER (bound <= 0.35) > 0 AS satisfied FROM b)
  SELECT b.knob, round(b.risk, 8) AS risk, round(b.bound, 8) AS bound, satisfied FROM b JOIN k USING (knob)""")
def risk_control(spark, sf):
    long = fc(spark, sf).select(F.explode(F.array(*map(F.lit, GRID))).alias("knob"), "y", "pred")
    out = V.risk_control(long.select("knob", (F.col("y") > F.col("pred") * F.col("knob")).cast("int").alias("loss")), "knob", "loss", 0.35)
    return out.select("knob", r("risk", 8).alias("risk"), r("bound", 8).alias("bound"), "satisfied")


@q("fit_effect_eb", f"""WITH {FC}, g AS (SELECT grp, avg(y - pred) AS m, var_samp(y - pred) / count(*) AS v FROM fc GROUP BY 1 HAVING count(*) > 2), t AS (SELECT avg(m) AS mu, greatest(var_samp(m) - avg(v), 0) AS tau FROM g) SELECT grp, round((m * tau + mu * v) / (tau + v), 2) AS effect FROM g, t""")
def effect_eb(spark, sf):
    d = F.col("y") - F.col("pred")
    g = fc(spark, sf).groupBy("grp").agg(F.avg(d).alias("m"), (F.var_samp(d) / F.count("*")).alias("v"), F.count("*").alias("c")).where("c > 2")
    t = g.agg(F.avg("m").alias("mu"), F.greatest(F.var_samp("m") - F.avg("v"), F.lit(0.0)).alias("tau"))
    return g.crossJoin(F.broadcast(t)).select("grp", r(F.expr("(m * tau + mu * v) / (tau + v)"), 2).alias("effect"))


@q("pit_ceiling", f"""WITH {PANEL}, q AS (SELECT a.epoch, quantile_cont(b.total, 0.99) AS c FROM (SELECT DISTINCT epoch FROM panel) a JOIN panel b ON b.epoch < a.epoch GROUP BY 1), m AS (SELECT entity, epoch, period, max(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM panel)
  SELECT entity, epoch, period, round(1.25 * greatest(m, c), 4) AS ceiling FROM m LEFT JOIN q USING (epoch)""")
def pit_ceiling(spark, sf):
    p = panel(spark, sf)
    e = p.select(F.col("epoch").alias("e")).distinct()  # a row per year
    past = p.groupBy("epoch", "total").agg(F.count("*").alias("n")).join(F.broadcast(e), F.col("epoch") < F.col("e"))
    c = K.weighted_quantiles(past, ["e"], "total", "n", {"c": 0.99}, save).withColumnRenamed("e", "epoch")
    m = W.trailing(p, ["entity"], EP, None, {"m": F.max("total")})
    return m.join(F.broadcast(c), "epoch", "left").select(*KEY, r(1.25 * F.greatest("m", "c"), 4).alias("ceiling"))
