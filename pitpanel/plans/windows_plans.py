"""Window operators on the customer-month panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.operators import ranks as K
from pitpanel.operators import windows as W
from pitpanel.plans.bindings import GPANEL, PANEL, grouped_panel, observations, OBS, panel, r, table, money
from pitpanel.sources.tables import save

EP, KEY = ["epoch", "period"], ["entity", "epoch", "period"]
QUERIES, SQL = {}, {}


def q(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@q("win_trailing_n_prior", f"""WITH {PANEL} SELECT entity, epoch, period, n,
  round(avg(total) OVER w, 4) AS mean_l4, count(*) OVER w AS n_l4 FROM panel
  WINDOW w AS (PARTITION BY entity, epoch ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def trailing_n_prior(spark, sf):
    out = W.trailing(panel(spark, sf), ["entity", "epoch"], ["period"], 4, {"mean_l4": F.avg("total"), "n_l4": F.count("*")})
    return out.select(*KEY, "n", r("mean_l4").alias("mean_l4"), "n_l4")


@q("win_expanding_prior", f"""WITH {PANEL} SELECT entity, epoch, period, round(avg(total) OVER w, 4) AS mean_prior,
  round(stddev_samp(total) OVER w, 2) AS std_prior FROM panel
  WINDOW w AS (PARTITION BY entity, epoch ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_prior(spark, sf):
    out = W.trailing(panel(spark, sf), ["entity", "epoch"], ["period"], None, {"m": F.avg("total"), "s": F.stddev_samp("total")})
    return out.select(*KEY, r("m").alias("mean_prior"), r("s", 2).alias("std_prior"))


@q("win_cross_epoch", f"""WITH {PANEL} SELECT entity, epoch, period, round(avg(total) OVER w, 4) AS mean_l6 FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def cross_epoch(spark, sf):
    return W.trailing(panel(spark, sf), ["entity"], EP, 6, {"m": F.avg("total")}).select(*KEY, r("m").alias("mean_l6"))


@q("win_ratio_of_sums", f"""WITH {PANEL} SELECT entity, epoch, period,
  round(sum(total) OVER w / nullif(sum(n) OVER w, 0), 4) AS rate_l8 FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def ratio_of_sums(spark, sf):
    out = W.trailing(panel(spark, sf), ["entity"], EP, 8, {"s": F.sum("total"), "c": F.sum("n")})
    return out.select(*KEY, r(F.try_divide("s", "c")).alias("rate_l8"))


@q("win_inclusive_multi", f"""WITH {PANEL} SELECT entity, epoch, period, round(m3, 4) AS mean_3, round(m6, 4) AS mean_6,
  round(ma, 4) AS mean_all, round(m3 - ma, 4) AS trend FROM (SELECT *,
  avg(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3,
  avg(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m6,
  avg(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ma FROM panel)""")
def inclusive_multi(spark, sf):
    df = panel(spark, sf)
    for name, n in (("m3", 3), ("m6", 6), ("ma", None)):
        df = W.trailing(df, ["entity"], EP, n, {name: F.avg("total")}, inclusive=True)
    return df.select(*KEY, r("m3").alias("mean_3"), r("m6").alias("mean_6"), r("ma").alias("mean_all"), r(F.col("m3") - F.col("ma")).alias("trend"))


@q("win_last_value_nonnull", f"""WITH {PANEL} SELECT entity, epoch, period, last_value(value IGNORE NULLS) OVER w AS newest FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def last_nonnull(spark, sf):
    return W.trailing(panel(spark, sf), ["entity"], EP, 4, {"newest": F.last("value", True)}).select(*KEY, "newest")


@q("win_latest_vs_rest", f"""WITH {PANEL} SELECT entity, epoch, period,
  CASE WHEN c >= 2 THEN round(l - (s - l) / (c - 1), 4) END AS jump FROM (SELECT *, last_value(value IGNORE NULLS) OVER w AS l,
  sum(value) OVER w AS s, count(value) OVER w AS c FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))""")
def latest_vs_rest(spark, sf):
    return W.latest_vs_rest(panel(spark, sf), ["entity"], EP, 4, "value", "j").select(*KEY, r("j").alias("jump"))


@q("win_trend_ratio", f"""WITH {PANEL} SELECT entity, epoch, period, round(a / nullif(b, 0), 6) AS trend FROM (SELECT *,
  avg(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a,
  avg(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM panel)""")
def trend_ratio(spark, sf):
    df = W.trailing(panel(spark, sf), ["entity"], EP, 4, {"a": F.avg("total")})
    df = W.trailing(df, ["entity"], EP, None, {"b": F.avg("total")})
    return df.select(*KEY, r(F.try_divide("a", "b"), 6).alias("trend"))


@q("win_countif", f"""WITH {PANEL} SELECT entity, epoch, period, CAST(count(*) FILTER (total > 200000) OVER w AS BIGINT) AS n_big FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def win_countif(spark, sf):
    big = F.count(F.when(F.col("total") > 200000, 1))
    return W.trailing(panel(spark, sf), ["entity"], EP, 8, {"n_big": big}).select(*KEY, "n_big")


@q("win_min_source_epoch", f"""WITH {PANEL} SELECT entity, epoch, period, min(CASE WHEN value IS NOT NULL THEN epoch END) OVER w AS first_epoch,
  coalesce(min(CASE WHEN value IS NOT NULL THEN epoch END) OVER w < epoch, false) AS crosses FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def min_source_epoch(spark, sf):
    seen = F.min(F.when(F.col("value").isNotNull(), F.col("epoch")))
    out = W.trailing(panel(spark, sf), ["entity"], EP, 4, {"first_epoch": seen})
    return out.select(*KEY, "first_epoch", F.coalesce(F.col("first_epoch") < F.col("epoch"), F.lit(False)).alias("crosses"))


@q("win_max_source_order", f"""WITH {PANEL} SELECT entity, epoch, period, max(epoch * 100 + period) OVER w AS source_order FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)""")
def max_source_order(spark, sf):
    newest = F.max(F.col("epoch") * 100 + F.col("period"))
    return W.trailing(panel(spark, sf), ["entity"], EP, 1, {"source_order": newest}).select(*KEY, "source_order")


@q("win_lag_delta", f"""WITH {PANEL} SELECT entity, epoch, period, round(total - lag(total) OVER w, 2) AS up,
  round(lag(total) OVER w - total, 2) AS down FROM panel WINDOW w AS (PARTITION BY entity ORDER BY epoch, period)""")
def lag_delta(spark, sf):
    before = F.lag("total").over(W.ordered(["entity"], EP))
    return panel(spark, sf).select(*KEY, r(F.col("total") - before, 2).alias("up"), r(before - F.col("total"), 2).alias("down"))


@q("win_row_number_dedup", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) = 1""")
def row_number_dedup(spark, sf):
    o = table(spark, sf, "orders")
    best = W.first_row(o, ["o_custkey"], ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@q("win_dedup_nulls_last", f"""WITH {PANEL} SELECT entity, epoch, period, value FROM panel
  QUALIFY row_number() OVER (PARTITION BY entity, epoch ORDER BY value ASC NULLS LAST, period) = 1""")
def dedup_nulls_last(spark, sf):
    return W.first_row(panel(spark, sf), ["entity", "epoch"], [F.col("value").asc_nulls_last(), "period"]).select(*KEY, "value")


@q("win_first_and_last", f"""WITH {OBS} SELECT user_id, event_type, count(*) AS n, arg_min(value, (observed_at, event_id)) AS opening,
  arg_max(value, (observed_at, event_id)) AS latest,
  round(arg_max(value, (observed_at, event_id)) - arg_min(value, (observed_at, event_id)), 4) AS movement FROM obs GROUP BY 1, 2""")
def first_and_last(spark, sf):
    out = W.first_and_last(observations(spark, sf), ["user_id", "event_type"], "observed_at", "event_id", "value")
    return out.withColumn("movement", r("movement"))


@q("win_ordinal", f"""WITH {PANEL} SELECT entity, epoch, period, row_number() OVER (PARTITION BY entity ORDER BY epoch, period) AS ordinal FROM panel""")
def ordinal(spark, sf):
    return panel(spark, sf).select(*KEY, F.row_number().over(W.ordered(["entity"], EP)).cast("long").alias("ordinal"))


@q("win_rank_composite", f"""WITH {PANEL} SELECT entity, epoch, period, rank() OVER (PARTITION BY epoch, period ORDER BY total DESC, entity) AS rnk FROM panel""")
def rank_composite(spark, sf):
    w = W.ordered(EP, [F.desc("total"), "entity"])
    return panel(spark, sf).select(*KEY, F.rank().over(w).cast("long").alias("rnk"))


@q("win_percent_rank_null_safe", f"""WITH {PANEL} SELECT entity, epoch, period, CASE WHEN value IS NOT NULL THEN
  round(percent_rank() OVER (PARTITION BY epoch, period, value IS NULL ORDER BY value), 8) END AS pct FROM panel""")
def percent_rank_null_safe(spark, sf):
    k = K.ranked(panel(spark, sf).select(*KEY, "value", F.col("value").isNull().alias("none")), [*EP, "none"], "value", save)
    p = F.coalesce(F.try_divide(F.col("rank") - 1, F.col("rank_all") - 1), F.lit(0.0))
    return k.select(*KEY, F.when(~F.col("none"), r(p, 8)).alias("pct"))


@q("win_rank_pct", f"""WITH {PANEL} SELECT entity, epoch, period, CASE WHEN value IS NOT NULL THEN round(
  (rank() OVER (PARTITION BY epoch, period, value IS NULL ORDER BY value) +
   (count(*) OVER (PARTITION BY epoch, period, value) - 1) / 2.0)
  / count(*) OVER (PARTITION BY epoch, period, value IS NULL), 8) END AS pct FROM panel""")
def rank_pct(spark, sf):
    k = K.ranked(panel(spark, sf).select(*KEY, "value", F.col("value").isNull().alias("none")), [*EP, "none"], "value", save)
    p = (F.col("rank") + (F.col("rank_ties") - 1) / 2) / F.col("rank_all")
    return k.select(*KEY, F.when(~F.col("none"), r(p, 8)).alias("pct"))


@q("win_share_of_partition", f"""WITH {GPANEL} SELECT entity, epoch, period, grp,
  round(total / sum(total) OVER (PARTITION BY grp, epoch, period), 8) AS share FROM gpanel""")
def share_of_partition(spark, sf):
    return W.share_of_group(grouped_panel(spark, sf), ["grp", *EP], "total", "s").select(*KEY, "grp", r("s", 8).alias("share"))


@q("win_topk_share", f"""WITH {GPANEL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, epoch, period ORDER BY total DESC, entity) AS k FROM gpanel),
  g AS (SELECT grp, epoch, period, sum(CASE WHEN k <= 2 THEN total END) / sum(total) AS share FROM ranked GROUP BY 1, 2, 3)
  SELECT grp, epoch, period, round(share, 8) AS share, round(avg(share) OVER w, 6) AS share_l4 FROM g
  WINDOW w AS (PARTITION BY grp ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def topk_share(spark, sf):
    k = F.row_number().over(W.ordered(["grp", *EP], [F.desc("total"), "entity"]))
    g = grouped_panel(spark, sf).withColumn("k", k).groupBy("grp", *EP).agg(
        (F.sum(F.when(F.col("k") <= 2, F.col("total"))) / F.sum("total")).alias("s")
    )
    out = W.trailing(g, ["grp"], EP, 4, {"m": F.avg("s")})
    return out.select("grp", *EP, r("s", 8).alias("share"), r("m", 6).alias("share_l4"))


CONSENSUS = f"""WITH {GPANEL}, p AS (SELECT *,
  CASE WHEN value IS NOT NULL THEN percent_rank() OVER (PARTITION BY grp, epoch, period, value IS NULL ORDER BY value) END AS p1,
  percent_rank() OVER (PARTITION BY grp, epoch, period, false ORDER BY n) AS p2 FROM gpanel),
  s AS (SELECT *, (coalesce(p1, 0) + p2) / (CASE WHEN p1 IS NULL THEN 1 ELSE 2 END) AS score, count(*) OVER (PARTITION BY grp, epoch, period) AS support FROM p)"""


def consensus(spark, sf):
    df = W.percent_rank_null_safe(grouped_panel(spark, sf), ["grp", *EP], "value", "p1")
    df = W.percent_rank_null_safe(df, ["grp", *EP], "n", "p2")
    parts = F.when(F.col("p1").isNull(), 1).otherwise(2)
    df = df.withColumn("score", (F.coalesce("p1", F.lit(0)) + F.col("p2")) / parts)
    return df.withColumn("support", F.count("*").over(Window.partitionBy("grp", *EP)))


@q("win_consensus_rank", f"""{CONSENSUS} SELECT entity, epoch, period, grp,
  CASE WHEN support >= 3 THEN row_number() OVER (PARTITION BY grp, epoch, period ORDER BY round(score, 8) DESC, total DESC, entity) END AS place,
  CASE WHEN support >= 3 THEN 'ranked' ELSE 'thin' END AS label FROM s""")
def consensus_rank(spark, sf):
    df = consensus(spark, sf)
    place = F.row_number().over(W.ordered(["grp", *EP], [F.round("score", 8).desc(), F.desc("total"), "entity"])).cast("long")
    enough = F.col("support") >= 3
    return df.select(*KEY, "grp", F.when(enough, place).alias("place"), F.when(enough, "ranked").otherwise("thin").alias("label"))


@q("win_edge_score", f"""{CONSENSUS} SELECT entity, epoch, period, grp, round(score, 6) AS edge,
  (score >= 0.6 AND least(coalesce(p1, p2), p2) >= 0.3) AS easy FROM s""")
def edge_score(spark, sf):
    low = F.least(F.coalesce("p1", "p2"), F.col("p2"))
    return consensus(spark, sf).select(*KEY, "grp", r("score", 6).alias("edge"), ((F.col("score") >= 0.6) & (low >= 0.3)).alias("easy"))


@q("win_prior_count_career", f"""WITH {GPANEL}, top AS (SELECT * FROM gpanel QUALIFY row_number() OVER (PARTITION BY grp, epoch, period ORDER BY total DESC, entity) = 1)
  SELECT grp, epoch, period, entity, count(*) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS starts FROM top""")
def prior_count_career(spark, sf):
    top = W.first_row(grouped_panel(spark, sf), ["grp", *EP], [F.desc("total"), "entity"])
    return W.trailing(top, ["entity"], EP, None, {"starts": F.count("*")}).select("grp", *EP, "entity", "starts")


@q("win_trailing_n_sum_min_periods", f"""WITH {PANEL} SELECT entity, epoch, period, CASE WHEN count(value) OVER w >= 2 THEN round(sum(value) OVER w, 2) END AS sum_l4 FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def sum_min_periods(spark, sf):
    return W.gated_sum(panel(spark, sf), ["entity"], EP, 4, "value", 2, "s").select(*KEY, r("s", 2).alias("sum_l4"))


@q("win_cumulative_official", """SELECT o_orderkey, o_orderpriority, o_custkey, round(avg(o_totalprice) OVER w, 4) AS mean_l20 FROM orders
  WINDOW w AS (PARTITION BY o_custkey % 100, o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def cumulative_official(spark, sf):
    o = table(spark, sf, "orders").withColumn("official", F.col("o_custkey") % 100)
    out = W.trailing(o, ["official", "o_orderpriority"], ["o_orderdate", "o_orderkey"], 20, {"m": F.avg("o_totalprice")})
    return out.select("o_orderkey", "o_orderpriority", "o_custkey", r("m").alias("mean_l20"))


@q("win_tercile_exact", f"""WITH {GPANEL}, f AS (SELECT *, row_number() OVER (PARTITION BY grp, epoch ORDER BY total DESC, entity, period) <= ceil(count(*) OVER (PARTITION BY grp, epoch) / 3.0) AS hi,
  row_number() OVER (PARTITION BY grp, epoch ORDER BY n DESC, entity, period) <= ceil(count(*) OVER (PARTITION BY grp, epoch) / 3.0) AS busy FROM gpanel)
  SELECT grp, epoch, hi, busy, count(*) AS rows FROM f GROUP BY 1, 2, 3, 4""")
def tercile_exact(spark, sf):
    g = ["grp", "epoch"]
    df = grouped_panel(spark, sf)
    df = df.withColumns({
        "hi": W.top_share(df, g, [F.desc("total"), "entity", "period"], 3),
        "busy": W.top_share(df, g, [F.desc("n"), "entity", "period"], 3),
    })
    return df.groupBy(*g, "hi", "busy").agg(F.count("*").alias("rows"))


@q("win_quintile_bands", f"""WITH {PANEL}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY epoch ORDER BY total, entity, period) - 1) * 5 / count(*) OVER (PARTITION BY epoch)) AS BIGINT) AS band FROM panel)
  SELECT epoch, band, count(*) AS rows, round(avg(total), 4) AS mean FROM b GROUP BY 1, 2""")
def quintile_bands(spark, sf):
    df = K.bands(panel(spark, sf), ["epoch"], ["total", "entity", "period"], 5, "band", save)
    return df.groupBy("epoch", "band").agg(F.count("*").alias("rows"), r(F.avg("total")).alias("mean"))
