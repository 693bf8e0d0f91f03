"""Further panel, market and study operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.functions import exprs as X
from pitpanel.operators import asof as A
from pitpanel.operators import evaluate as V
from pitpanel.operators import ranks as K
from pitpanel.operators import series as SE
from pitpanel.operators import spine as SP
from pitpanel.operators import tracking as TR
from pitpanel.operators import windows as W
from pitpanel.operators.nearest import nearest
from pitpanel.plans.bindings import FACTS, GPANEL, OBS, PANEL, facts, grouped_panel, money, observations, panel, r, spread, table
from pitpanel.sources import tables as T
from pitpanel.sources.tables import save

EP, KEY = ["epoch", "period"], ["entity", "epoch", "period"]
QUERIES, SQL = {}, {}
TRAITS = ["speed_mean", "speed_p90", "accel_p90", "marker_speed_p90", "depth_mean", "depth_p90", "separation_mean"]
D = "CAST(sum(CAST({} AS DECIMAL(20,4))) AS DOUBLE)"


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@q("changepoint_panel")
def changepoint_panel(spark, sf):
    p = panel(spark, sf).select("entity", (F.col("epoch") * 100 + F.col("period")).alias("mon"), (F.col("total") / 1e5).alias("x"))
    return SE.panel(p, ["entity"], "mon", "x")


@q("cusum_panel")
def cusum_panel(spark, sf):
    p = panel(spark, sf).select("entity", (F.col("epoch") * 12 + F.col("period")).alias("at"), (F.col("total") / 1e5).alias("x"))
    return SE.cusum_panel(p, ["entity"], "at", "x", h=1.5, least=3)


# two-sided p of Student's t: with x = sqrt(df) tan(a), its density is in proportion to cos(a) ^ (df - 1)
_COS = "list_sum(list_transform(range(400), lambda i: pow(cos({w} * (i + 0.5) / 400), df - 1))) * {w}"


@q("two_window_test", f"""WITH {PANEL}, w AS (SELECT *, avg(total) OVER a AS m1, var_samp(total) OVER a AS v1, count(*) OVER a AS n1, avg(total) OVER b AS m2, var_samp(total) OVER b AS v2, count(*) OVER b AS n2 FROM panel
  WINDOW a AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), b AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 7 PRECEDING AND 2 PRECEDING)),
  t AS (SELECT entity, epoch, period, CASE WHEN n1 = 2 AND n2 >= 3 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t, CASE WHEN n1 = 2 AND n2 >= 3 THEN pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) END AS df FROM w)
  SELECT entity, epoch, period, round(t, 4) AS t, round(df, 4) AS df, coalesce(round(1 - {_COS.format(w="atan(abs(t) / sqrt(df))")} / ({_COS.format(w="(pi() / 2)")}), 5), 1.0) AS p FROM t""")
def two_window(spark, sf):
    """Welch's t of the last two values against the six before; p is 1 where there are too few."""
    a = W.ordered(["entity"], EP).rowsBetween(-1, 0)
    b = W.ordered(["entity"], EP).rowsBetween(-7, -2)
    x = panel(spark, sf).withColumns({f"{n}{i}": f("total").over(w) for i, w in ((1, a), (2, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))})
    x = x.withColumn("enough", (F.col("n1") == 2) & (F.col("n2") >= 3))
    x = x.withColumns({
        "t": F.when(F.col("enough"), F.expr("(m1 - m2) / sqrt(v1 / n1 + v2 / n2)")),
        "df": F.when(F.col("enough"), F.expr("pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))")),
    })
    p = SE.two_sided_p(F.col("t"), F.col("df"))
    return x.select(*KEY, r("t").alias("t"), r("df").alias("df"), F.coalesce(F.when(F.col("t").isNotNull(), r(p, 5)), F.lit(1.0)).alias("p"))


@q("eval_normal_crps", f"""WITH {PANEL}, w AS (SELECT *, avg(total) OVER w AS m, stddev_samp(total) OVER w AS s FROM panel WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)), z AS (SELECT *, (total - m) / s AS z FROM w WHERE s > 0)
  SELECT entity, epoch, period, round(s * (z * (2 * ({X.normal_cdf_sql("z")}) - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())), 3) AS crps FROM z""")
def normal_crps(spark, sf):
    p = W.trailing(panel(spark, sf), ["entity"], EP, 6, {"m": F.avg("total"), "s": F.stddev_samp("total")}).where("s > 0")
    return p.select(*KEY, r(X.normal_crps(F.col("total"), F.col("m"), F.col("s")), 3).alias("crps"))


@q("lag_watchlist", f"WITH {PANEL}, l AS (SELECT *, avg(total) OVER w AS m, avg(n) OVER w AS c FROM panel WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) SELECT entity, epoch, period FROM l WHERE total > 1.5 * m AND abs(n - c) <= 0.5")
def watchlist(spark, sf):
    p = W.trailing(panel(spark, sf), ["entity"], EP, 4, {"m": F.avg("total"), "c": F.avg("n")})
    return p.where((F.col("total") > 1.5 * F.col("m")) & (F.abs(F.col("n") - F.col("c")) <= 0.5)).select(*KEY)


@q("xp_bucket_expected", f"""WITH {FACTS}, b AS (SELECT *, CAST(floor(qty / 10) AS BIGINT) AS qb, CAST(round(disc * 100) AS BIGINT) AS db, CAST(year(day) AS BIGINT) AS epoch FROM facts), rates AS (SELECT qb, db, {D.format('net')} / count(*) AS rate FROM b WHERE epoch < 1997 GROUP BY 1, 2)
  SELECT grp, epoch, count(*) AS n, round(sum(rate), 2) AS expected, round({D.format('net')}, 2) AS actual FROM b JOIN rates USING (qb, db) WHERE epoch >= 1997 GROUP BY 1, 2""")
def xp(spark, sf):
    b = facts(spark, sf).withColumns({"qb": F.floor(F.col("qty") / 10), "db": F.round(F.col("disc") * 100).cast("long"), "epoch": F.year("day").cast("long")})
    rates = b.where("epoch < 1997").groupBy("qb", "db").agg((money("net") / F.count("*")).alias("rate"))  # 6 x 11 buckets
    return b.where("epoch >= 1997").join(F.broadcast(rates), ["qb", "db"]).groupBy("grp", "epoch").agg(F.count("*").alias("n"), r(F.sum("rate"), 2).alias("expected"), r(money("net"), 2).alias("actual"))


@q("vacated_opportunity", f"""WITH {GPANEL}, m AS (SELECT DISTINCT grp, epoch, period FROM gpanel), last AS (SELECT entity, grp, epoch, period, total, lead(epoch * 12 + period) OVER (PARTITION BY entity ORDER BY epoch, period) AS nxt FROM gpanel)
  SELECT m.grp, m.epoch, m.period, coalesce(round({D.format('total')}, 2), 0) AS vacated FROM m LEFT JOIN last l ON l.grp = m.grp AND l.epoch * 12 + l.period = m.epoch * 12 + m.period - 1 AND coalesce(l.nxt, 0) <> m.epoch * 12 + m.period GROUP BY 1, 2, 3""")
def vacated(spark, sf):
    p = grouped_panel(spark, sf).withColumn("mon", F.col("epoch") * 12 + F.col("period"))
    last = p.withColumn("nxt", F.lead("mon").over(W.ordered(["entity"], ["mon"]))).where("coalesce(nxt, 0) <> mon + 1")
    gone = last.groupBy("grp", (F.col("mon") + 1).alias("mon")).agg(money("total").alias("v"))
    return p.select("grp", *EP, "mon").distinct().join(gone, ["grp", "mon"], "left").select("grp", *EP, r(F.coalesce("v", F.lit(0.0)), 2).alias("vacated"))


@q("with_without_split", f"""WITH {GPANEL}, star AS (SELECT grp, arg_max(entity, (round(s, 2), -entity)) AS star FROM (SELECT grp, entity, sum(total) AS s FROM gpanel GROUP BY 1, 2) GROUP BY 1), p AS (SELECT g.*, star, max((entity = star)::INT) OVER (PARTITION BY g.grp, epoch, period) AS here FROM gpanel g JOIN star USING (grp))
  SELECT entity, grp, count(*) AS n, round(avg(total) FILTER (here = 0) - avg(total) FILTER (here = 1), 6) AS delta FROM p WHERE entity <> star GROUP BY 1, 2""")
def with_without(spark, sf):
    p = grouped_panel(spark, sf)
    s = p.groupBy("grp", "entity").agg(F.sum("total").alias("s"))
    star = s.groupBy("grp").agg(F.max_by("entity", F.struct(F.round("s", 2), -F.col("entity"))).alias("star"))
    p = p.join(star, "grp")
    here = p.where("entity = star").select("grp", *EP, F.lit(True).alias("here"))
    p = p.where("entity <> star").join(here, ["grp", *EP], "left")
    d = F.avg(F.when(F.col("here").isNull(), F.col("total"))) - F.avg(F.when(F.col("here"), F.col("total")))
    return p.groupBy("entity", "grp").agg(F.count("*").alias("n"), r(d, 6).alias("delta"))


@q("boom_flags", f"WITH {GPANEL}, x AS (SELECT *, row_number() OVER (PARTITION BY grp, epoch, period ORDER BY total DESC, entity) AS k, lag(total) OVER (PARTITION BY entity ORDER BY epoch, period) AS p, percent_rank() OVER (PARTITION BY epoch, period ORDER BY n) AS pr FROM gpanel) SELECT entity, epoch, period, (k = 1 OR coalesce(total > 3 * p, false) OR pr >= 0.9) AS boom FROM x")
def boom(spark, sf):
    k = F.row_number().over(W.ordered(["grp", *EP], [F.desc("total"), "entity"]))
    before = F.lag("total").over(W.ordered(["entity"], EP))
    g = grouped_panel(spark, sf).withColumns({"k": k, "before": before})
    g = K.ranked(g.select(*KEY, "n", "total", "k", "before"), EP, "n", save)
    pr = F.coalesce(F.try_divide(F.col("rank") - 1, F.col("rank_all") - 1), F.lit(0.0))
    return g.select(*KEY, ((F.col("k") == 1) | F.coalesce(F.col("total") > 3 * F.col("before"), F.lit(False)) | (pr >= 0.9)).alias("boom"))


CURVE = """quotes AS (SELECT p_brand AS item, p_size AS point, round(1 - (p_size + p_partkey % 7) / 60.0, 6) AS p FROM part), lad AS (SELECT item, point, min(p) AS p FROM quotes GROUP BY 1, 2), mono AS (SELECT item, point, min(p) OVER (PARTITION BY item ORDER BY point ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY item) AS n FROM lad)"""


def curve(spark, sf):
    """A survival curve per item from a ladder of quotes, made monotone by a running minimum."""
    quote = F.round(1 - (F.col("p_size") + F.col("p_partkey") % 7) / 60, 6)
    lad = table(spark, sf, "part").groupBy(F.col("p_brand").alias("item"), F.col("p_size").alias("point")).agg(F.min(quote).alias("p"))
    w = W.ordered(["item"], ["point"]).rowsBetween(Window.unboundedPreceding, 0)
    return lad.select("item", "point", F.min("p").over(w).alias("s"), F.count("*").over(Window.partitionBy("item")).alias("n"))


@q("market_curve_quantiles", f"""WITH {CURVE}, b AS (SELECT item, point, s, lead(point) OVER v AS p2, lead(s) OVER v AS s2, lag(point) OVER v AS p0, lag(s) OVER v AS s0, n, row_number() OVER (PARTITION BY item ORDER BY point DESC) AS last FROM mono WINDOW v AS (PARTITION BY item ORDER BY point)),
  i AS (SELECT item, {", ".join(f"min(CASE WHEN s >= {t} AND s2 < {t} THEN point + (s - {t}) / nullif(s - s2, 0) * (p2 - point) END) AS q{q}" for q, t in ((50, 0.5), (90, 0.1)))}, max(CASE WHEN last = 1 THEN s END) AS se, max(CASE WHEN last = 1 THEN point END) AS pe, max(CASE WHEN last = 1 AND s0 > s AND s > 0 THEN (point - p0) / ln(s0 / s) END) AS scale FROM b WHERE n >= 3 GROUP BY 1)
  SELECT item, {", ".join(f"round(coalesce(q{q}, CASE WHEN se > {t} THEN pe + scale * ln(se / {t}) END), 4) AS q{q}" for q, t in ((50, 0.5), (90, 0.1)))}, se > 0.1 AND q90 IS NULL AS extrapolated FROM i""")
def curve_quantiles(spark, sf):
    """Median and 90th percentile of each item's curve, between its points; beyond the last one the tail falls as between the last two, exponentially."""
    w = W.ordered(["item"], ["point"])
    near = {"p2": F.lead("point").over(w), "s2": F.lead("s").over(w), "p0": F.lag("point").over(w), "s0": F.lag("s").over(w), "last": F.lead("point").over(w).isNull()}
    b = curve(spark, sf).withColumns(near).where("n >= 3")
    cut = lambda t: F.min(F.when((F.col("s") >= t) & (F.col("s2") < t), F.col("point") + F.try_divide(F.col("s") - t, F.col("s") - F.col("s2")) * (F.col("p2") - F.col("point"))))
    end = lambda e: F.max(F.when(F.col("last"), F.expr(e)))
    i = b.groupBy("item").agg(cut(0.5).alias("q50"), cut(0.1).alias("q90"), end("s").alias("se"), end("point").alias("pe"), end("case when s0 > s and s > 0 then (point - p0) / ln(s0 / s) end").alias("scale"))
    beyond = lambda t: F.when(F.col("se") > t, F.col("pe") + F.col("scale") * F.ln(F.col("se") / t))
    return i.select("item", r(F.coalesce("q50", beyond(0.5))).alias("q50"), r(F.coalesce("q90", beyond(0.1))).alias("q90"), ((F.col("se") > 0.1) & F.col("q90").isNull()).alias("extrapolated"))


_Z = "(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))"
_TAIL = "1 - list_sum(list_transform(range(CAST(floor(point) AS BIGINT) + 1), lambda k: exp(-(a.lo + a.hi) / 2 + k * ln((a.lo + a.hi) / 2) - lgamma(k + 1))))"


@q("market_points", f"""WITH quotes AS (SELECT p_brand AS item, p_type AS family, p_size % 4 + 0.5 AS point, CASE WHEN p_size % 2 = 0 THEN 100.0 / (200 + p_size) ELSE (100.0 + p_size) / (200 + p_size) END AS p FROM part), f AS (SELECT item, family, point, avg(p / (p + 0.5)) AS fair FROM quotes GROUP BY 1, 2, 3), s AS (SELECT *, sqrt(-2 * ln(least(fair, 1 - fair))) AS t FROM f),
  m AS (SELECT item, family, CASE WHEN family IN ('PROMO', 'ECONOMY') THEN list_reduce(range(40), lambda a, x: CASE WHEN {_TAIL} < fair THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} END, {{'lo': 0.0::DOUBLE, 'hi': 50.0::DOUBLE}}).lo ELSE point + 5.0 * CASE WHEN fair >= 0.5 THEN {_Z} ELSE -{_Z} END END AS mean FROM s), a AS (SELECT item, family, avg(mean) AS mean FROM m GROUP BY 1, 2)
  SELECT item, round(sum(mean * CASE WHEN family IN ('PROMO', 'ECONOMY') THEN 6.0 ELSE 0.1 END), 5) AS points, count(*) AS families FROM a GROUP BY 1""")
def market_points(spark, sf):
    """Fair over-prices by item, family and line, averaged over quotes; each inverted to a mean, of a Poisson or a normal
    variable by the family; means averaged over lines, and summed over families in points."""
    from pitpanel.functions.exprs import devig, implied_probability, normal_mean, poisson_mean

    counts = F.col("family").isin("PROMO", "ECONOMY")
    price = F.when(F.col("p_size") % 2 == 0, 100 + F.col("p_size")).otherwise(-(100 + F.col("p_size")))
    point = (F.col("p_size") % 4 + 0.5).alias("point")
    f = table(spark, sf, "part").groupBy(F.col("p_brand").alias("item"), F.col("p_type").alias("family"), point).agg(F.avg(devig(implied_probability(price), F.lit(0.5))).alias("fair"))
    m = f.withColumn("mean", F.when(counts, poisson_mean(F.col("fair"), F.col("point"))).otherwise(normal_mean(F.col("fair"), F.col("point"), 5.0)))
    a = m.groupBy("item", "family").agg(F.avg("mean").alias("mean"))
    return a.groupBy("item").agg(r(F.sum(F.col("mean") * F.when(counts, 6.0).otherwise(0.1)), 5).alias("points"), F.count("*").alias("families"))


@q("market_tail_gap", f"WITH {PANEL}, l AS (SELECT entity, epoch, max(total) - min(total) AS own, quantile_cont(total, 0.9) - quantile_cont(total, 0.1) AS market FROM panel GROUP BY 1, 2) SELECT entity, epoch, round(own - market, 3) AS gap FROM l ORDER BY abs(own - market) DESC, entity, epoch LIMIT 30")
def tail_gap(spark, sf):
    g = panel(spark, sf).groupBy("entity", "epoch").agg((F.max("total") - F.min("total")).alias("own"), (F.percentile("total", F.lit(0.9)) - F.percentile("total", F.lit(0.1))).alias("market"))
    gap = F.col("own") - F.col("market")
    return g.select("entity", "epoch", gap.alias("gap")).orderBy(F.abs("gap").desc(), "entity", "epoch").limit(30).withColumn("gap", r("gap", 3))


@q("source_disagreement", "SELECT c_custkey, round(c_acctbal - s_acctbal, 2) AS diff FROM customer JOIN supplier ON upper(split_part(c_name, '#', 2)) = upper(split_part(s_name, '#', 2)) ORDER BY abs(c_acctbal - s_acctbal) DESC, c_custkey LIMIT 20")
def disagreement(spark, sf):
    key = lambda c: F.upper(F.split_part(c, F.lit("#"), F.lit(2)))
    c = table(spark, sf, "customer").withColumn("k", key("c_name"))
    s = table(spark, sf, "supplier").withColumn("k", key("s_name"))
    d = F.col("c_acctbal") - F.col("s_acctbal")
    return c.join(s, "k").select("c_custkey", d.alias("d")).orderBy(F.abs("d").desc(), "c_custkey").limit(20).select("c_custkey", r("d", 2).alias("diff"))


@q("double_count_guard", f"WITH {OBS}, n AS (SELECT user_id, avg(k) - 50 AS lean, avg(value) - 50 AS market FROM obs GROUP BY 1) SELECT user_id FROM n WHERE sign(round(lean, 6)) = sign(round(market, 6)) AND abs(lean) > 1")
def double_count(spark, sf):
    n = observations(spark, sf).groupBy("user_id").agg((F.avg("k") - 50).alias("lean"), (F.avg("value") - 50).alias("market"))
    return n.where((F.signum(F.round("lean", 6)) == F.signum(F.round("market", 6))) & (F.abs("lean") > 1)).select("user_id")


@q("participation_share", f"WITH {FACTS}, b AS (SELECT count(DISTINCT basket) AS n FROM facts WHERE qty > 0) SELECT entity, count(DISTINCT basket) AS baskets, round(count(DISTINCT basket) * 1.0 / max(n), 8) AS share, round(count(DISTINCT basket) FILTER (flag = 'R') * 1.0 / count(DISTINCT basket), 8) AS returned FROM facts, b WHERE qty > 0 GROUP BY 1")
def participation(spark, sf):
    f = facts(spark, sf).where("qty > 0")
    n = f.agg(F.count_distinct("basket").alias("all"))
    g = f.groupBy("entity").agg(F.count_distinct("basket").alias("baskets"), F.count_distinct(F.when(F.col("flag") == "R", F.col("basket"))).alias("back"))
    return g.crossJoin(F.broadcast(n)).select("entity", "baskets", r(F.col("baskets") / F.col("all"), 8).alias("share"), r(F.col("back") / F.col("baskets"), 8).alias("returned"))


@q("coverage_fit_edges", f"WITH {FACTS}, y AS (SELECT grp, CAST(year(day) AS BIGINT) AS epoch, flag, avg(qty) AS m, count(*) AS n FROM facts GROUP BY 1, 2, 3), mix AS (SELECT grp, epoch, sum(m * n) / sum(n) AS overall FROM y GROUP BY 1, 2) SELECT a.grp, a.epoch, a.flag, CASE WHEN b.n >= 2 THEN round(b.m - overall, 6) END AS edge FROM y a JOIN y b ON a.grp = b.grp AND a.flag = b.flag AND a.epoch = b.epoch + 1 JOIN mix ON mix.grp = a.grp AND mix.epoch = b.epoch")
def coverage_fit(spark, sf):
    y = facts(spark, sf).groupBy("grp", F.year("day").cast("long").alias("epoch"), "flag").agg(F.avg("qty").alias("m"), F.count("*").alias("n"))
    overall = F.sum(F.col("m") * F.col("n")).over(Window.partitionBy("grp", "epoch")) / F.sum("n").over(Window.partitionBy("grp", "epoch"))
    prior = y.withColumn("edge", F.when(F.col("n") >= 2, r(F.col("m") - overall, 6))).select("grp", (F.col("epoch") + 1).alias("epoch"), "flag", "edge")
    return y.select("grp", "epoch", "flag").join(prior, ["grp", "epoch", "flag"])


# an order is a play of three frames, a part in it a subject; even orders run to the left
@q("tracking_traits", f"""WITH {FACTS}, l AS (SELECT basket, entity, min(line) AS line, max(qty) AS qty, max(disc) AS disc, min(day) AS day FROM facts GROUP BY 1, 2),
  raw AS (SELECT basket, entity, k AS frame, year(day) * 12 + month(day) AS period, CASE line % 3 WHEN 0 THEN 'marker' WHEN 1 THEN 'target' ELSE 'mover' END AS role, qty + 20 * disc * k AS x, line * 6 + qty * k / 50 AS y, qty / 10 + disc * 10 * k AS speed, disc * 10 + k AS accel FROM l, (SELECT unnest([0, 1, 2]) AS k)),
  f AS (SELECT * REPLACE (CASE WHEN basket % 2 = 0 THEN 120 - x ELSE x END AS x, CASE WHEN basket % 2 = 0 THEN 53.3 - y ELSE y END AS y) FROM raw),
  base AS (SELECT entity, count(*) AS frames, count(DISTINCT period) AS periods, max(period) AS last_period, count(DISTINCT basket) FILTER (role <> 'marker') AS mover_plays, count(DISTINCT basket) FILTER (role = 'marker') AS marker_plays, avg(speed) FILTER (role <> 'marker') AS speed_mean, quantile_cont(speed, 0.9) FILTER (role <> 'marker') AS speed_p90,
    count(speed) FILTER (role <> 'marker') AS speed_n, quantile_cont(accel, 0.9) FILTER (role <> 'marker') AS accel_p90, quantile_cont(speed, 0.9) FILTER (role = 'marker') AS marker_speed_p90, count(speed) FILTER (role = 'marker') AS marker_speed_n FROM f GROUP BY 1),
  d AS (SELECT basket, entity, arg_max(x, frame) - arg_min(x, frame) AS depth FROM f WHERE role <> 'marker' GROUP BY 1, 2), dd AS (SELECT entity, avg(depth) AS depth_mean, quantile_cont(depth, 0.9) AS depth_p90 FROM d GROUP BY 1),
  s AS (SELECT t.basket, t.entity, min(sqrt(pow(t.x - m.x, 2) + pow(t.y - m.y, 2))) AS d FROM f t JOIN f m ON m.basket = t.basket AND m.role = 'marker' AND m.frame = 2 WHERE t.role = 'target' AND t.frame = 2 GROUP BY 1, 2), ss AS (SELECT entity, avg(d) AS separation_mean, count(*) AS target_plays FROM s GROUP BY 1)
  SELECT entity, frames, periods, CAST(last_period AS BIGINT) AS last_period, mover_plays, marker_plays, speed_n, marker_speed_n, coalesce(target_plays, 0) AS target_plays, {", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in TRAITS)} FROM base LEFT JOIN dd USING (entity) LEFT JOIN ss USING (entity)""")
def tracking(spark, sf):
    """Traits of parts as subjects of an order's frames: speeds and depths as mover, distance from the nearest marker."""
    # parts lie together from here on, so what is counted of each is not shuffled again with its frames
    f = spread(facts(spark, sf).select("basket", "entity", "line", "qty", "disc", "day"), table(spark, sf, "lineitem").count(), "entity")
    one = f.groupBy("basket", "entity").agg(F.min("line").alias("line"), F.max("qty").alias("qty"), F.max("disc").alias("disc"), F.min("day").alias("day"))
    f = one.withColumn("frame", F.explode(F.array(*map(F.lit, range(3))))).select(
        "basket", "entity", "frame", (F.year("day") * 12 + F.month("day")).cast("long").alias("period"),
        F.expr("CASE line % 3 WHEN 0 THEN 'marker' WHEN 1 THEN 'target' ELSE 'mover' END").alias("role"),
        F.expr("qty + 20 * disc * frame").alias("x"), F.expr("line * 6 + qty * frame / 50").alias("y"),
        F.expr("qty / 10 + disc * 10 * frame").alias("speed"), F.expr("disc * 10 + frame").alias("accel"),
    )
    f = TR.oriented(f, F.col("basket") % 2 == 0, 120, 53.3)
    out = TR.traits(f, ["basket"], "entity", "frame", "period", role="role", movers=["mover", "target"], target="target", marker="marker")
    kept = ["entity", "frames", "periods", "last_period", "mover_plays", "marker_plays", "speed_n", "marker_speed_n", "target_plays"]
    return out.select(*kept, *[(r(c, 8) + F.lit(0.0)).alias(c) for c in TRAITS])


@q("winner_registry", "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 4 = 0) SELECT k, max(v) AS v, count(*) AS sources FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a WHERE k % 8 = 0)) GROUP BY 1")
def registry_of_winners(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    a, b = o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("k % 4 = 0").drop("o_orderstatus")
    b = b.join(a.where("k % 8 = 0").select("k"), "k", "left_anti")
    return a.unionByName(b).groupBy("k").agg(F.max("v").alias("v"), F.count("*").alias("sources"))


@q("money_by_period", """SELECT CAST(year(o_orderdate) AS INTEGER) AS epoch, CAST(month(o_orderdate) AS INTEGER) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, count(*) AS n,
  CASE WHEN min(o_orderdate) < TIMESTAMP '1997-01-01' AND month(o_orderdate) % 3 = 0 THEN 'checked' ELSE 'imported' END AS note, CASE WHEN min(o_orderdate) < TIMESTAMP '1997-01-01' AND month(o_orderdate) % 3 = 0 THEN 1.5 * month(o_orderdate) END AS best FROM orders GROUP BY 1, 2, month(o_orderdate)""")
def money_by_period(spark, sf):
    """Money by month, imported twice (the second time with later orders too); notes made between the two stay."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("epoch"), F.month("o_orderdate").alias("period"), "o_totalprice", "o_orderkey")
    path, key = T.workspace(spark), ["epoch", "period"]
    manual = {"note": "imported", "best": None}
    by = lambda d: d.groupBy(*key).agg(money("o_totalprice").alias("spent"), F.count("*").alias("n"))
    T.upsert(by(o.where("epoch < 1997 and o_orderkey % 2 = 0")), path, key, ["epoch"], {**manual, "best": float("nan")})
    notes = by(o.where("epoch < 1997 and period % 3 = 0")).select(*key, F.lit("checked").alias("note"), (1.5 * F.col("period")).alias("best"))
    T.upsert(by(o.where("epoch < 1997")), path, key, ["epoch"], {**manual, "best": float("nan")})
    T.set_manual(notes, path, key, ["epoch"], ["note", "best"])
    for _ in range(2):  # the second time changes nothing
        T.upsert(by(o), path, key, ["epoch"], {**manual, "best": float("nan")})
    out = T.read(spark, path)
    return out.select(*key, "spent", "n", "note", F.nanvl("best", F.lit(None).cast("double")).alias("best"))


@q("score_recorded_baskets", f"WITH {FACTS}, a AS (SELECT p_partkey AS entity, p_size FROM part WHERE p_partkey % 5 <> 0), s AS (SELECT basket, coalesce(sum(p_size), 0)::BIGINT AS score, count(p_size) AS scored FROM facts LEFT JOIN a USING (entity) GROUP BY 1) SELECT * FROM s ORDER BY score DESC, basket LIMIT 30")
def score_recorded(spark, sf):
    a = table(spark, sf, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("entity"), "p_size")
    s = facts(spark, sf).join(a, "entity", "left").groupBy("basket").agg(F.coalesce(F.sum("p_size"), F.lit(0)).alias("score"), F.count("p_size").alias("scored"))
    return s.orderBy(F.desc("score"), "basket").limit(30)


@q("trailing_score_two_families", f"WITH {FACTS}, s AS (SELECT 'group' AS family, grp AS k, day, qty * 0.5 AS x FROM facts UNION ALL SELECT 'item', entity, day, qty * 0.25 FROM facts) SELECT family, k, count(*) AS n, round(avg(x), 6) AS mean FROM s WHERE day < DATE '1998-01-01' GROUP BY 1, 2 HAVING count(*) >= 2")
def two_families(spark, sf):
    f = facts(spark, sf).where("day < date'1998-01-01'")
    rows = [F.struct(F.lit(n).alias("family"), F.col(c).alias("k"), (F.col("qty") * w).alias("x")) for n, c, w in (("group", "grp", 0.5), ("item", "entity", 0.25))]
    g = f.select(F.inline(F.array(*rows))).groupBy("family", "k").agg(F.count("*").alias("n"), r(F.avg("x"), 6).alias("mean"))
    return g.where("n >= 2")


@q("pull_union_prefer_largest", f"WITH {OBS}, o AS (SELECT *, CAST(observed_at AS DATE) AS d FROM obs), n AS (SELECT event_type, max(d) AS d FROM o GROUP BY 1), p AS (SELECT o.*, count(*) OVER (PARTITION BY o.event_type) AS size FROM o JOIN n USING (event_type, d)) SELECT user_id, event_type, event_id FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY size DESC, event_type, event_id DESC) = 1")
def prefer_largest(spark, sf):
    o = observations(spark, sf).withColumn("d", F.to_date("observed_at"))
    p = o.join(o.groupBy("event_type").agg(F.max("d").alias("d"), ), ["event_type", "d"])
    size = p.groupBy("event_type").agg(F.count("*").alias("size"))
    return W.first_row(p.join(size, "event_type"), ["user_id"], [F.desc("size"), "event_type", F.desc("event_id")]).select("user_id", "event_type", "event_id")


@q("tiered_fallback_value", f"WITH {PANEL} SELECT entity, epoch, period, round(coalesce(avg(value) OVER w, avg(total) OVER w, 150000) + CASE WHEN count(*) OVER w < 2 THEN -5000 WHEN count(*) OVER w < 4 THEN 0 ELSE 2500 END, 4) AS estimate FROM panel WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
def tiered(spark, sf):
    p = W.trailing(panel(spark, sf), ["entity"], EP, 4, {"a": F.avg("value"), "b": F.avg("total"), "c": F.count("*")})
    step = F.when(F.col("c") < 2, -5000).when(F.col("c") < 4, 0).otherwise(2500)
    return p.select(*KEY, r(F.coalesce("a", "b", F.lit(150000.0)) + step).alias("estimate"))


@q("lookup_precise_then_loose", "WITH l AS (SELECT p_name, p_type, p_brand, max(p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2, 3), m AS (SELECT p_name, max(p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p.p_partkey, coalesce(l.v, m.v) AS v, l.v IS NOT NULL AS precise FROM part p LEFT JOIN l ON l.p_name = p.p_name AND l.p_type = p.p_type AND l.p_brand = p.p_brand LEFT JOIN m ON m.p_name = p.p_name WHERE coalesce(l.v, m.v) IS NOT NULL")
def precise_loose(spark, sf):
    p = table(spark, sf, "part")
    even = p.where("p_partkey % 2 = 0")
    keys = ["p_name", "p_type", "p_brand"]
    one = lambda k, n: even.groupBy(*k).agg(F.max("p_size").alias(n))
    j = p.select("p_partkey", *keys).join(one(keys, "a"), keys, "left").join(one(["p_name"], "b"), "p_name", "left")
    return j.where("coalesce(a, b) is not null").select("p_partkey", F.coalesce("a", "b").alias("v"), F.col("a").isNotNull().alias("precise"))


@q("capture_rate", f"WITH {FACTS}, c AS (SELECT grp, flag, max(qty) AS best, max(CASE WHEN basket % 3 = 0 THEN qty END) AS held FROM facts GROUP BY 1, 2) SELECT flag, count(*) AS classes, round(avg(coalesce(held = best, false)::INT), 8) AS captured, round(avg(best - held), 6) AS gap FROM c GROUP BY 1")
def capture(spark, sf):
    c = facts(spark, sf).groupBy("grp", "flag").agg(F.max("qty").alias("best"), F.max(F.when(F.col("basket") % 3 == 0, F.col("qty"))).alias("held"))
    hit = F.coalesce(F.col("held") == F.col("best"), F.lit(False)).cast("int")
    return c.groupBy("flag").agg(F.count("*").alias("classes"), r(F.avg(hit), 8).alias("captured"), r(F.avg(F.col("best") - F.col("held")), 6).alias("gap"))


@q("best_vs_rest_anatomy", f"WITH {FACTS}, f AS (SELECT basket, CAST(year(min(day)) AS BIGINT) AS epoch, count(*) AS n, sum(qty) AS q FROM facts GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY q DESC, basket) AS k, count(*) OVER (PARTITION BY epoch) AS c FROM f) SELECT epoch, CASE WHEN k = 1 THEN 'best' WHEN (k - 1) * 5 < c THEN 'top' ELSE 'rest' END AS band, count(*) AS baskets, round(avg(n), 6) AS items FROM k GROUP BY 1, 2")
def anatomy(spark, sf):
    f = facts(spark, sf).groupBy("basket").agg(F.year(F.min("day")).cast("long").alias("epoch"), F.count("*").alias("n"), F.sum("qty").alias("q"))
    f = K.numbered(f, ["epoch"], [F.desc("q"), "basket"], save, "k")
    band = F.when(F.col("k") == 1, "best").when((F.col("k") - 1) * 5 < F.col("k_all"), "top").otherwise("rest")
    return f.groupBy("epoch", band.alias("band")).agg(F.count("*").alias("baskets"), r(F.avg("n"), 6).alias("items"))


@q("entries_to_line", f"""WITH {PANEL}, g AS (SELECT epoch, period, (quantile_cont(total, 0.99) - avg(total)) / stddev_samp(total) AS z FROM panel GROUP BY 1, 2), p AS (SELECT *, 1 - ({X.normal_cdf_sql("z")}) AS p FROM g)
  SELECT epoch, period, CAST(ceil(ln(0.5) / ln(1 - greatest(p, 1e-9))) AS BIGINT) AS entries FROM p""")
def entries_to_line(spark, sf):
    g = panel(spark, sf).groupBy(*EP).agg(F.avg("total").alias("m"), F.stddev_samp("total").alias("s"), F.percentile("total", F.lit(0.99)).alias("line"))
    g = g.withColumn("p", 1 - X.normal_cdf((F.col("line") - F.col("m")) / F.col("s")))
    return g.select(*EP, F.ceil(F.log(F.lit(0.5)) / F.log(1 - F.greatest("p", F.lit(1e-9)))).alias("entries"))


@q("reach_curve_ev", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT * FROM (VALUES (1, 0.05), (5, 0.2), (10, 0.35), (20, 0.5), (1000, 0.5)) t(x, y)), b AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM k) SELECT o_custkey, n, round((y + (y2 - y) * (n - x) / (x2 - x)) * 100 - n, 6) AS ev FROM c JOIN b ON n >= x AND n < x2")
def reach(spark, sf):
    points = [(1, 0.05), (5, 0.2), (10, 0.35), (20, 0.5), (1000, 0.5)]
    steps = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(x2).alias("x2"), F.lit(y2).alias("y2")) for (x, y), (x2, y2) in zip(points, points[1:], strict=False)]
    b = spark.range(1).select(F.inline(F.array(*steps)))  # four steps
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = c.join(F.broadcast(b), (F.col("n") >= F.col("x")) & (F.col("n") < F.col("x2")))
    return j.select("o_custkey", "n", r(F.expr("(y + (y2 - y) * (n - x) / (x2 - x)) * 100 - n"), 6).alias("ev"))


@q("market_tail_edge_centered", f"""WITH {GPANEL}, s AS (SELECT entity, grp, epoch, max(total) - min(total) AS own, CASE WHEN count(*) FILTER (period <= 9) >= 2 THEN (quantile_cont(total, 0.9) FILTER (period <= 9)) - (quantile_cont(total, 0.1) FILTER (period <= 9)) END AS market FROM gpanel GROUP BY 1, 2, 3),
  m AS (SELECT grp, epoch, quantile_cont(own - market, 0.5) AS med FROM s GROUP BY 1, 2), c AS (SELECT epoch, count(*) AS rows, count(market) AS quoted, round(count(market) * 1.0 / count(*), 6) AS coverage FROM s GROUP BY 1)
  SELECT entity, s.epoch, round(own - market - med, 6) + 0.0 AS edge, rows, quoted, coverage FROM s JOIN m ON m.grp = s.grp AND m.epoch = s.epoch JOIN c ON c.epoch = s.epoch""")
def edge_centered(spark, sf):
    """Own spread less the market's as known at the cutoff (two quotes at least), less the group's median, and how many
    rows of the epoch the market covers; rows without a market have no edge and stay."""
    known = F.when(F.col("period") <= 9, F.col("total"))
    spread = F.percentile(known, F.lit(0.9)) - F.percentile(known, F.lit(0.1))
    s = grouped_panel(spark, sf).groupBy("entity", "grp", "epoch").agg((F.max("total") - F.min("total")).alias("own"), F.when(F.count(known) >= 2, spread).alias("market"))
    s = s.withColumn("gap", F.col("own") - F.col("market"))
    m = s.groupBy("grp", "epoch").agg(F.percentile("gap", F.lit(0.5)).alias("med"))
    c = s.groupBy("epoch").agg(F.count("*").alias("rows"), F.count("market").alias("quoted"), r(F.count("market") / F.count("*"), 6).alias("coverage"))
    out = s.join(m, ["grp", "epoch"]).join(F.broadcast(c), "epoch")  # a row per year
    return out.select("entity", "epoch", (r(F.col("gap") - F.col("med"), 6) + F.lit(0.0)).alias("edge"), "rows", "quoted", "coverage")


@q("market_open_last_dispersion", f"WITH {OBS}, q AS (SELECT event_type AS item, user_id AS book, arg_min(value, (observed_at, event_id)) AS o, arg_max(value, (observed_at, event_id)) AS l, count(*) AS n FROM obs GROUP BY 1, 2) SELECT item, round(avg(o), 6) AS opening, round(avg(l), 6) AS latest, round(stddev_samp(l), 6) AS dispersion, count(*) AS books, sum(n)::BIGINT AS snapshots FROM q GROUP BY 1")
def open_last(spark, sf):
    b = W.first_and_last(observations(spark, sf), ["event_type", "user_id"], "observed_at", "event_id", "value")
    return b.groupBy(F.col("event_type").alias("item")).agg(r(F.avg("opening"), 6).alias("opening"), r(F.avg("latest"), 6).alias("latest"), r(F.stddev_samp("latest"), 6).alias("dispersion"), F.count("*").alias("books"), F.sum("n").alias("snapshots"))


@q("asof_weighted_recent", f"WITH {PANEL} SELECT entity, epoch, period, round(sum(n * total) OVER w / nullif(sum(n) OVER w, 0), 4) AS weighted, max(epoch * 100 + period) OVER w AS source_order FROM panel WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
def weighted_recent(spark, sf):
    aggs = {"a": F.sum(F.col("n") * F.col("total")), "b": F.sum("n"), "source_order": F.max(F.col("epoch") * 100 + F.col("period"))}
    return W.trailing(panel(spark, sf), ["entity"], EP, 4, aggs).select(*KEY, r(F.try_divide("a", "b")).alias("weighted"), "source_order")


@q("asof_group_last8", f"WITH {GPANEL}, g AS (SELECT grp, epoch, period, {D.format('total')} AS t, sum(n)::BIGINT AS n FROM gpanel GROUP BY 1, 2, 3) SELECT grp, epoch, period, round(sum(t) OVER w / nullif(sum(n) OVER w, 0), 3) AS rate_l8, count(*) OVER w AS support FROM g WINDOW w AS (PARTITION BY grp ORDER BY epoch, period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)")
def group_last8(spark, sf):
    g = grouped_panel(spark, sf).groupBy("grp", *EP).agg(money("total").alias("t"), F.sum("n").alias("n"))
    out = W.trailing(g, ["grp"], EP, 8, {"a": F.sum("t"), "b": F.sum("n"), "support": F.count("*")})
    return out.select("grp", *EP, r(F.try_divide("a", "b"), 3).alias("rate_l8"), "support")


@q("multiclass_scores", "WITH p AS (SELECT o_orderkey, o_orderstatus AS truth, unnest(['F', 'O', 'P']) AS c, unnest([0.5, 0.3, 0.2]) AS p FROM orders) SELECT round(-avg(ln(greatest(p, 1e-15))) FILTER (c = truth), 8) AS log_loss, round(sum(pow(p - (c = truth)::INT, 2)) / count(DISTINCT o_orderkey), 8) AS brier FROM p")
def multiclass(spark, sf):
    wide = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit(0.5).alias("F"), F.lit(0.3).alias("O"), F.lit(0.2).alias("P"))
    p = wide.unpivot(["o_orderkey", "o_orderstatus"], ["F", "O", "P"], "c", "p")
    own = F.col("c") == F.col("o_orderstatus")
    return p.agg(r(-F.avg(F.when(own, F.log(F.greatest("p", F.lit(1e-15))))), 8).alias("log_loss"), r(F.sum(F.pow(F.col("p") - own.cast("int"), 2)) / F.count_distinct("o_orderkey"), 8).alias("brier"))


@q("state_emission_medians", f"WITH {FACTS}, s AS (SELECT flag, status, qty / sum(qty) OVER (PARTITION BY basket) AS share, year(day) AS y FROM facts) SELECT flag, status, round(quantile_cont(share, 0.5), 8) AS median FROM s WHERE y < 1998 GROUP BY 1, 2")
def emissions(spark, sf):
    s = W.share_of_group(facts(spark, sf), ["basket"], "qty", "share").where(F.year("day") < 1998)
    return K.quantiles(s, ["flag", "status"], "share", {"median": 0.5}, save).select("flag", "status", r("median", 8).alias("median"))


@q("share_cap_check", f"WITH {FACTS} SELECT basket, round(sum(disc), 4) AS total FROM facts GROUP BY 1 HAVING round(sum(disc), 4) > 0.3")
def cap_check(spark, sf):
    return facts(spark, sf).groupBy("basket").agg(r(F.sum("disc")).alias("total")).where("total > 0.3")


@q("calibration_deciles", f"WITH {FACTS}, u AS (SELECT basket, line, entity, grp, 'a' AS arm, qty / 50 AS p, (flag = 'R')::INT AS y FROM facts UNION ALL SELECT basket, line, entity, grp, 'b', disc * 10, (flag = 'R')::INT FROM facts), k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY arm ORDER BY p, basket, line, entity, grp) - 1) * 10 / count(*) OVER (PARTITION BY arm)) AS BIGINT) AS decile FROM u) SELECT arm, decile, count(*) AS rows, round(avg(p), 6) AS mean_p FROM k GROUP BY 1, 2")
def deciles(spark, sf):
    f = facts(spark, sf).select("basket", "line", "entity", "grp", (F.col("qty") / 50).alias("a"), (F.col("disc") * 10).alias("b"))
    u = K.bands(f.unpivot(["basket", "line", "entity", "grp"], ["a", "b"], "arm", "p"), ["arm"], ["p", "basket", "line", "entity", "grp"], 10, "decile", save)
    return u.groupBy("arm", "decile").agg(F.count("*").alias("rows"), r(F.avg("p"), 6).alias("mean_p"))


@q("brier_skill_loo", f"""WITH {FACTS}, e AS (SELECT CAST(year(day) AS BIGINT) AS epoch, count(*) AS n, sum((flag = 'R')::INT) AS h, sum(pow(qty / 50 - (flag = 'R')::INT, 2)) AS b FROM facts GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(h) AS th FROM e), x AS (SELECT *, (th - h) * 1.0 / (tn - n) AS base FROM e, t),
  g AS (SELECT CAST(year(day) AS BIGINT) AS epoch, qty, count(*) AS n, sum((flag = 'R')::INT) AS h FROM facts GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS cn, sum(h) OVER w AS ch, sum(n) OVER (PARTITION BY epoch) AS an, sum(h) OVER (PARTITION BY epoch) AS ah FROM g WINDOW w AS (PARTITION BY epoch ORDER BY qty DESC)),
  d AS (SELECT epoch, sum(h * ((an - ah) - (cn - ch) + (n - h) / 2.0)) / nullif(max(ah) * max(an - ah), 0) AS auc, CASE WHEN max(ah) > 0 AND max(an) > max(ah) THEN sum(h * ch / cn) / max(ah) END AS ap FROM c GROUP BY 1)
  SELECT epoch, round(b / n, 8) AS brier, round(1 - (b / n) / (h * 1.0 / n * pow(1 - base, 2) + (1 - h * 1.0 / n) * pow(base, 2)), 6) AS skill, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM x JOIN d USING (epoch)""")
def skill(spark, sf):
    """By year: Brier score, skill against the other years' rate, ROC AUC and average precision (null with one class)."""
    hit = (F.col("flag") == "R").cast("int")
    f = facts(spark, sf).select(F.year("day").cast("long").alias("epoch"), "qty", hit.alias("hit"))
    e = f.groupBy("epoch").agg(F.count("*").alias("n"), F.sum("hit").alias("h"), F.sum(F.pow(F.col("qty") / 50 - F.col("hit"), 2)).alias("b"))
    t = e.agg(F.sum("n").alias("tn"), F.sum("h").alias("th"))
    x = e.crossJoin(F.broadcast(t)).withColumn("base", F.expr("(th - h) / (tn - n)"))
    d = K.discrimination(f, ["epoch"], "qty", "hit", save)
    return x.join(d, "epoch").select("epoch", r(F.expr("b / n"), 8).alias("brier"), r(F.expr("1 - (b / n) / (h / n * pow(1 - base, 2) + (1 - h / n) * pow(base, 2))"), 6).alias("skill"), r("roc_auc", 6).alias("roc_auc"), r("average_precision", 6).alias("average_precision"))


@q("poisson_binomial_tail", f"WITH {FACTS}, g AS (SELECT basket, list_sort(list(disc)) AS ps FROM facts GROUP BY 1) SELECT basket, round(list_reduce(ps, lambda a, p: [a[1] * (1 - p), a[2] * (1 - p) + a[1] * p, a[3] * (1 - p) + a[2] * p, a[4] + a[3] * p], [1.0, 0.0, 0.0, 0.0]::DOUBLE[])[4], 9) AS p3 FROM g")
def poisson_binomial(spark, sf):
    """P(at least 3 of a basket's events) from the exact distribution, carried as an array over its items."""
    g = facts(spark, sf).groupBy("basket").agg(F.array_sort(F.collect_list("disc")).alias("ps"))
    zero = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def step(acc, p):
        keep = lambda i: F.get(acc, i)
        return F.array(keep(0) * (1 - p), keep(1) * (1 - p) + keep(0) * p, keep(2) * (1 - p) + keep(1) * p, keep(3) + keep(2) * p)

    return g.select("basket", r(F.get(F.aggregate("ps", zero, step), 3), 9).alias("p3"))


@q("conditional_lift", f"WITH {FACTS}, b AS (SELECT basket, bool_or(flag = 'R') AS a, bool_or(qty > 40) AS b FROM facts GROUP BY 1) SELECT count(*) FILTER (a AND b) AS both, round((count(*) FILTER (a AND b) * 1.0 / count(*) FILTER (a)) / (count(*) FILTER (NOT a AND b) * 1.0 / count(*) FILTER (NOT a)), 8) AS lift FROM b")
def conditional_lift(spark, sf):
    b = facts(spark, sf).groupBy("basket").agg(F.bool_or(F.col("flag") == "R").alias("a"), F.bool_or(F.col("qty") > 40).alias("b"))
    n = lambda e: F.count_if(F.expr(e))
    return b.agg(n("a and b").alias("both"), r((n("a and b") / n("a")) / (n("not a and b") / n("not a")), 8).alias("lift"))


@q("placement_in_samples", f"WITH {FACTS}, t AS (SELECT grp, avg(qty) AS y FROM facts WHERE flag = 'R' GROUP BY 1) SELECT grp, round(avg((qty < y)::INT), 8) AS percentile, round(quantile_cont(qty, 0.9), 6) AS q90 FROM facts JOIN t USING (grp) GROUP BY 1")
def placement(spark, sf):
    f = facts(spark, sf)
    t = f.where("flag = 'R'").groupBy("grp").agg(F.avg("qty").alias("y"))
    return f.join(t, "grp").groupBy("grp").agg(r(F.avg((F.col("qty") < F.col("y")).cast("int")), 8).alias("percentile"), r(F.percentile("qty", F.lit(0.9)), 6).alias("q90"))


@q("item_share_profile", f"WITH {FACTS} SELECT basket, round(sum(disc), 4) AS total, max(disc) AS top, count(*) FILTER (disc < 0.02) AS low, count(*) FILTER (disc > 0.08) AS high FROM facts GROUP BY 1")
def share_profile(spark, sf):
    return facts(spark, sf).groupBy("basket").agg(r(F.sum("disc")).alias("total"), F.max("disc").alias("top"), F.count_if(F.col("disc") < 0.02).alias("low"), F.count_if(F.col("disc") > 0.08).alias("high"))


@q("admission_rule_sizing", f"WITH {FACTS} SELECT CAST(year(day) AS BIGINT) AS epoch, count(*) FILTER (qty >= 40) AS admitted, count(*) FILTER (qty >= 40 AND flag = 'R') AS winners, count(*) FILTER (flag = 'R') AS all_winners FROM facts GROUP BY 1")
def admission(spark, sf):
    n = lambda e: F.count_if(F.expr(e))
    return facts(spark, sf).groupBy(F.year("day").cast("long").alias("epoch")).agg(n("qty >= 40").alias("admitted"), n("qty >= 40 and flag = 'R'").alias("winners"), n("flag = 'R'").alias("all_winners"))


@q("parity_recompute", f"WITH {FACTS}, a AS (SELECT basket, avg(qty) AS m FROM facts GROUP BY 1), s AS (SELECT o_orderkey AS basket, 25 + o_orderkey % 3 AS stored FROM orders) SELECT basket, round(m, 6) AS recomputed, stored FROM a JOIN s USING (basket) WHERE abs(m - stored) > 10")
def parity(spark, sf):
    a = facts(spark, sf).groupBy("basket").agg(F.avg("qty").alias("m"))
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket"), (25 + F.col("o_orderkey") % 3).alias("stored"))
    return a.join(s, "basket").where(F.abs(F.col("m") - F.col("stored")) > 10).select("basket", r("m", 6).alias("recomputed"), "stored")


@q("set_stability", f"""WITH {FACTS}, t AS (SELECT flag, entity, row_number() OVER (PARTITION BY flag ORDER BY sum(qty) DESC, entity) AS k FROM facts GROUP BY 1, 2), p AS (SELECT unnest([10, 25, 50]) AS prefix), f AS (SELECT DISTINCT flag FROM facts),
  o AS (SELECT prefix, x.flag AS a, y.flag AS b, (SELECT count(*) FROM t JOIN t u ON u.entity = t.entity AND u.flag = y.flag AND u.k <= prefix WHERE t.flag = x.flag AND t.k <= prefix) AS shared FROM p, f x, f y WHERE x.flag < y.flag)
  SELECT CAST(prefix AS INTEGER) AS prefix, count(*) AS pairs, round(avg(shared), 6) AS mean_shared, min(shared) AS least, round(quantile_cont(shared, 0.1), 6) AS q10, round(quantile_cont(shared, 0.5), 6) AS q50, round(quantile_cont(shared, 0.9), 6) AS q90 FROM o GROUP BY 1""")
def stability(spark, sf):
    """The parts with the highest quantity under each flag: how many the flags' first 10, 25 and 50 share, pair by pair."""
    s = facts(spark, sf).groupBy("flag", "entity").agg(F.sum("qty").alias("q"))
    top = K.numbered(s, ["flag"], [F.desc("q"), "entity"], save, "k").where("k <= 50")
    sets = top.select("flag", "entity", F.explode(F.filter(F.array(*map(F.lit, (10, 25, 50))), lambda p: p >= F.col("k"))).alias("prefix"))
    other = sets.select(F.col("flag").alias("b"), "entity", "prefix")
    shared = sets.withColumnRenamed("flag", "a").join(other, ["entity", "prefix"]).where("a < b").groupBy("prefix", "a", "b").agg(F.count("*").alias("shared"))
    flags = sets.select("prefix", F.col("flag").alias("a")).distinct()  # a row for each set and prefix
    every = flags.join(flags.withColumnRenamed("a", "b"), "prefix").where("a < b")
    o = every.join(shared, ["prefix", "a", "b"], "left").select("prefix", F.coalesce("shared", F.lit(0)).alias("shared"))
    q = lambda x: r(F.percentile("shared", F.lit(x)), 6)
    return o.groupBy("prefix").agg(F.count("*").alias("pairs"), r(F.avg("shared"), 6).alias("mean_shared"), F.min("shared").alias("least"), q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"))


@q("out_status_union", "SELECT o_orderkey FROM orders WHERE upper(coalesce(o_orderstatus, '')) = 'P' OR upper(o_orderpriority) LIKE '5%'")
def out_status(spark, sf):
    return table(spark, sf, "orders").where((F.upper(F.coalesce("o_orderstatus", F.lit(""))) == "P") | F.upper("o_orderpriority").startswith("5")).select("o_orderkey")


@q("group_status_count", "SELECT c_nationkey, o_orderpriority, count(*) FILTER (o_orderstatus = 'P') AS n_out FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2")
def status_count(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return o.join(c, "o_custkey").groupBy("c_nationkey", "o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n_out"))


@q("knn_forecast", f"""WITH {GPANEL}, x AS (SELECT entity, epoch, grp, CAST(avg(total) AS DECIMAL(18,2)) AS v, max(total) AS y FROM gpanel GROUP BY 1, 2, 3), k AS (SELECT a.entity, a.epoch, a.y AS own, b.y, row_number() OVER (PARTITION BY a.entity, a.epoch ORDER BY abs(a.v - b.v), b.entity * 10000 + b.epoch) AS k FROM x a JOIN x b ON a.grp = b.grp AND b.epoch < a.epoch)
  SELECT entity, epoch, count(*) AS peers, round(avg(y), 2) AS mean, round(quantile_cont(y, 0.9), 2) AS q90, (max(own) <= quantile_cont(y, 0.9)) AS covered FROM k WHERE k <= 5 GROUP BY 1, 2""")
def knn(spark, sf):
    """Every row's five most similar rows of earlier epochs: mean and 0.9 quantile of their outcomes, and whether it held.

    A row of the pool serves every later epoch, of which there are a few.
    """
    x = save(grouped_panel(spark, sf).groupBy("entity", "epoch", "grp").agg(F.avg("total").cast("decimal(18,2)").alias("v"), F.max("total").alias("y")))
    later = x.select(F.col("epoch").alias("at")).distinct()
    targets = x.select("entity", F.col("epoch").alias("at"), "grp", "v", F.col("y").alias("own"))
    pool = x.join(F.broadcast(later), F.col("epoch") < F.col("at")).select("at", "grp", "v", "y", (F.col("entity") * 10000 + F.col("epoch")).alias("row_id"))
    found = nearest(targets, pool, ["grp", "at"], "v", ["entity"], "row_id", 5)
    q90 = F.percentile("y", F.lit(0.9))
    g = found.groupBy("entity", F.col("at").alias("epoch")).agg(F.count("*").alias("peers"), r(F.avg("y"), 2).alias("mean"), q90.alias("q"), F.max("own").alias("own"))
    return g.select("entity", "epoch", "peers", "mean", r("q", 2).alias("q90"), (F.col("own") <= F.col("q")).alias("covered"))
