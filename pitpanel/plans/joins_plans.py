"""Joins, as-of joins and spines on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.operators import asof as A
from pitpanel.operators import fuzzy
from pitpanel.operators import resolve as R
from pitpanel.operators import spine as S
from pitpanel.operators import windows as W
from pitpanel.operators.blocks import block_join
from pitpanel.operators.profiles import match_once, nearest_profiles
from pitpanel.plans.bindings import FACTS, GPANEL, OBS, PANEL, facts, grouped_panel, money, observations, panel, r, spread, table
from pitpanel.sources.tables import save

EP, KEY = ["epoch", "period"], ["entity", "epoch", "period"]
QUERIES, SQL = {}, {}


def q(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@q("join_equi_inner", "SELECT o_orderkey, l_linenumber, c_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND l_discount > 0.05")
def equi_inner(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    li = table(spark, sf, "lineitem").where("l_discount > 0.05")
    c = table(spark, sf, "customer")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "l_linenumber", "c_name")


@q("join_left_many", f"""WITH {PANEL}, prev AS (SELECT entity, epoch, period + 1 AS period, total AS prev_total FROM panel),
  bal AS (SELECT c_custkey AS entity, c_acctbal, c_nationkey FROM customer)
  SELECT p.entity, p.epoch, p.period, total, prev_total, c_acctbal, n_name, r_name FROM panel p LEFT JOIN prev USING (entity, epoch, period)
  LEFT JOIN bal USING (entity) LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def left_many(spark, sf):
    p = panel(spark, sf)
    prev = p.select("entity", "epoch", (F.col("period") + 1).alias("period"), F.col("total").alias("prev_total"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_acctbal", "c_nationkey")
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")  # 25 and 5 rows by the schema
    out = p.join(prev, KEY, "left").join(c, "entity", "left")
    out = out.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    out = out.join(F.broadcast(g), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return out.select(*KEY, "total", "prev_total", "c_acctbal", "n_name", "r_name")


@q("join_both_sides", """WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS grp, count(*) AS customers FROM customer GROUP BY 1),
  pairs AS (SELECT CAST(n_nationkey AS BIGINT) AS grp, CAST((n_nationkey + 1) % 25 AS BIGINT) AS opp FROM nation)
  SELECT p.grp, opp, a.customers AS own, b.customers AS against FROM pairs p LEFT JOIN s a ON a.grp = p.grp LEFT JOIN s b ON b.grp = p.opp""")
def both_sides(spark, sf):
    s = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("g")).agg(F.count("*").alias("c"))
    p = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("grp"), ((F.col("n_nationkey") + 1) % 25).cast("long").alias("opp"))
    out = p.join(s.select(F.col("g").alias("grp"), F.col("c").alias("own")), "grp", "left")
    return out.join(s.select(F.col("g").alias("opp"), F.col("c").alias("against")), "opp", "left").select("grp", "opp", "own", "against")


@q("join_self_opponent", f"""WITH {FACTS}, s AS (SELECT basket, flag, sum(CAST(net AS DECIMAL(20,4))) AS v FROM facts GROUP BY 1, 2)
  SELECT a.basket, a.flag AS side, b.flag AS other, round(CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE), 4) AS diff FROM s a JOIN s b ON a.basket = b.basket AND a.flag <> b.flag""")
def self_opponent(spark, sf):
    s = facts(spark, sf).groupBy("basket", "flag").agg(money("net").alias("v"))
    o = s.select("basket", F.col("flag").alias("other"), F.col("v").alias("ov"))
    return s.join(o, "basket").where("flag <> other").select("basket", F.col("flag").alias("side"), "other", r(F.col("v") - F.col("ov"), 4).alias("diff"))


@q("join_full_coalesce", """WITH a AS (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1)
  SELECT k, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM a FULL JOIN b USING (k)""")
def full_coalesce(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, ["k"], "full").na.fill(0, ["customers", "suppliers"])


@q("join_anti_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_exists(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@q("join_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey IS NOT NULL)")
def not_in(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 45 AND l_partkey IS NOT NULL").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(li, "p_partkey", "left_anti").select("p_partkey")


@q("join_semi_slice", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_slice(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@q("join_cross_grid", f"""WITH {FACTS}, units AS (SELECT DISTINCT grp, year(day) AS y FROM facts), roles AS (SELECT unnest(['A', 'N', 'R']) AS flag),
  ev AS (SELECT grp, year(day) AS y, flag, count(*) AS c FROM facts GROUP BY 1, 2, 3)
  SELECT grp, CAST(y AS BIGINT) AS epoch, flag, coalesce(c, 0) AS n FROM units CROSS JOIN roles LEFT JOIN ev USING (grp, y, flag)""")
def cross_grid(spark, sf):
    f = facts(spark, sf).withColumn("epoch", F.year("day").cast("long"))
    ev = f.groupBy("grp", "epoch", "flag").agg(F.count("*").alias("n"))
    roles = spark.range(1).select(F.explode(F.array(*map(F.lit, "ANR"))).alias("flag"))
    return S.grid(f.select("grp", "epoch").distinct(), roles, ev, ["grp", "epoch", "flag"], ["n"])


BUCKETS = """CASE WHEN disc < 0.03 THEN 'low' WHEN disc < 0.07 THEN 'mid' ELSE 'high' END AS db, CAST(floor(qty / 10) AS BIGINT) AS qb"""


@q("join_bucket_lookup", f"""WITH {FACTS}, b AS (SELECT *, {BUCKETS} FROM facts), rates AS (SELECT db, qb, round(CAST(sum(CAST(net AS DECIMAL(20,4))) AS DOUBLE) / count(*), 4) AS rate FROM b GROUP BY 1, 2)
  SELECT basket, line, rate FROM b JOIN rates USING (db, qb)""")
def bucket_lookup(spark, sf):
    b = facts(spark, sf).withColumns({
        "db": F.when(F.col("disc") < 0.03, "low").when(F.col("disc") < 0.07, "mid").otherwise("high"),
        "qb": F.floor(F.col("qty") / 10),
    })
    rates = b.groupBy("db", "qb").agg(r(money("net") / F.count("*")).alias("rate"))  # 3 x 6 buckets
    return b.join(F.broadcast(rates), ["db", "qb"]).select("basket", "line", "rate")


@q("join_disjunctive", """SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND (c_acctbal < s_acctbal OR (c_mktsegment = 'MACHINERY' AND s_suppkey % 2 = 0))""")
def disjunctive(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey", "c_acctbal", "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", "s_acctbal")
    more = (F.col("c_acctbal") < F.col("s_acctbal")) | ((F.col("c_mktsegment") == "MACHINERY") & (F.col("s_suppkey") % 2 == 0))
    return block_join(c, s, ["g"]).where(more).select("c_custkey", "s_suppkey")


@q("join_asof_strict_period", f"""WITH {PANEL}, src AS (SELECT *, avg(total) OVER w4 AS l4, count(*) OVER w4 AS support FROM panel
    WINDOW w4 AS (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
  tgt AS (SELECT c_custkey AS entity, e AS epoch, CAST(6 AS BIGINT) AS period FROM customer CROSS JOIN (SELECT DISTINCT epoch AS e FROM panel))
  SELECT t.entity, t.epoch, t.period, s.epoch * 100 + s.period AS source_order, s.total AS lag1, round(s.l4, 4) AS mean_l4, round(s.total - s.l4, 4) AS jump, s.support
  FROM tgt t ASOF LEFT JOIN src s ON t.entity = s.entity AND t.epoch * 100 + t.period > s.epoch * 100 + s.period""")
def asof_strict_period(spark, sf):
    p = panel(spark, sf)
    src = W.trailing(p, ["entity"], EP, 4, {"l4": F.avg("total"), "support": F.count("*")}, inclusive=True)
    src = src.withColumn("at", F.col("epoch") * 100 + F.col("period"))
    years = p.select("epoch").distinct()  # one row per calendar year
    tgt = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")).crossJoin(F.broadcast(years))
    tgt = tgt.withColumn("period", F.lit(6).cast("long")).withColumn("at", F.col("epoch") * 100 + F.col("period"))
    src = src.withColumn("source_order", F.col("at"))
    out = A.asof(tgt, src, ["entity"], ["at"], ["source_order", "total", "l4", "support"])
    return out.select(*KEY, F.col("asof_source_order").alias("source_order"), F.col("asof_total").alias("lag1"), r("asof_l4").alias("mean_l4"), r(F.col("asof_total") - F.col("asof_l4")).alias("jump"), F.col("asof_support").alias("support"))


@q("join_asof_inclusive", f"""WITH {PANEL}, tgt AS (SELECT DISTINCT entity, epoch, CAST(q AS BIGINT) AS period FROM panel CROSS JOIN (SELECT unnest([3, 6, 9, 12]) AS q))
  SELECT t.entity, t.epoch, t.period, s.period AS source_period, s.total FROM tgt t ASOF LEFT JOIN panel s ON t.entity = s.entity AND t.epoch = s.epoch AND t.period >= s.period""")
def asof_inclusive(spark, sf):
    p = panel(spark, sf)
    tgt = p.select("entity", "epoch").distinct().withColumn("period", F.explode(F.array(*[F.lit(x).cast("long") for x in (3, 6, 9, 12)])))
    out = A.asof(tgt, p.withColumn("source_period", F.col("period")), ["entity", "epoch"], ["period"], ["source_period", "total"], strict=False)
    return out.select(*KEY, F.col("asof_source_period").alias("source_period"), F.col("asof_total").alias("total"))


@q("join_asof_latest_epoch", f"WITH {PANEL} SELECT entity, epoch, max(period) AS period, arg_max(total, period) AS total FROM panel GROUP BY 1, 2")
def asof_latest_epoch(spark, sf):
    return panel(spark, sf).groupBy("entity", "epoch").agg(F.max_by(F.struct("period", "total"), "period").alias("s")).select("entity", "epoch", "s.period", "s.total")


@q("join_asof_timestamp", f"""WITH {OBS}, snaps AS (SELECT DISTINCT CAST(observed_at AS DATE) AS day, user_id FROM obs),
  o AS (SELECT o_orderkey, o_custkey % 50 AS user_id, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS day FROM orders)
  SELECT o_orderkey, o.user_id, o.day, s.day AS snapshot_day FROM o ASOF LEFT JOIN snaps s ON o.user_id = s.user_id AND o.day >= s.day""")
def asof_timestamp(spark, sf):
    snaps = observations(spark, sf).select("user_id", F.to_date("observed_at").alias("day")).distinct()
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("user_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("day"))
    out = A.asof(o, snaps.withColumn("snapshot_day", F.col("day")), ["user_id"], ["day"], ["snapshot_day"], strict=False)
    return out.select("o_orderkey", "user_id", "day", F.col("asof_snapshot_day").alias("snapshot_day"))


@q("asof_cutoff_revision", f"""WITH {OBS}, o AS (SELECT *, CAST(observed_at AS DATE) AS day FROM obs)
  SELECT user_id, day, event_id, event_type, value FROM o WHERE observed_at <= CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR
  QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, observed_at DESC, event_id DESC) = 1""")
def cutoff_revision(spark, sf):
    o = observations(spark, sf).withColumn("day", F.to_date("observed_at"))
    cut = o.select("day").distinct().withColumn("cutoff", F.expr("cast(day as timestamp) + interval 12 hours"))
    rank = [F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.desc("observed_at"), F.desc("event_id")]
    return A.asof_cutoff_revision(o, cut, ["user_id"], "day", "observed_at", "cutoff", rank).select("user_id", "day", "event_id", "event_type", "value")


@q("asof_common_cutoff_quotes", f"""WITH {OBS}, o AS (SELECT *, CAST(observed_at AS DATE) AS day FROM obs), c AS (SELECT day, min(observed_at) AS cutoff FROM o WHERE event_type = 'error' GROUP BY 1)
  SELECT day, event_type, arg_max(value, (observed_at, event_id)) FILTER (observed_at < cutoff) AS quote, count(*) FILTER (observed_at < cutoff) AS admitted,
  count(*) FILTER (observed_at >= cutoff) AS late FROM o JOIN c USING (day) GROUP BY 1, 2""")
def common_cutoff_quotes(spark, sf):
    o = observations(spark, sf).withColumn("day", F.to_date("observed_at"))
    c = o.where("event_type = 'error'").groupBy("day").agg(F.min("observed_at").alias("cutoff"))
    early = F.col("observed_at") < F.col("cutoff")
    at = F.when(early, F.struct("observed_at", "event_id"))
    return o.join(c, "day").groupBy("day", "event_type").agg(
        F.max_by("value", at).alias("quote"), F.count_if(early).alias("admitted"), F.count_if(~early).alias("late")
    )


@q("join_bounded_lookback", f"""WITH {PANEL}, m AS (SELECT *, epoch * 12 + period AS mon FROM panel) SELECT entity, epoch, period, count(*) OVER w AS n_l4, round(avg(total) OVER w, 4) AS mean_l4 FROM m
  WINDOW w AS (PARTITION BY entity ORDER BY mon RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def bounded_lookback(spark, sf):
    p = panel(spark, sf).withColumn("mon", F.col("epoch") * 12 + F.col("period"))
    out = A.lookback(p, ["entity"], "mon", 4, {"n_l4": F.count("*"), "m": F.avg("total")})
    return out.select(*KEY, "n_l4", r("m").alias("mean_l4"))


@q("join_ordinal_lookback", f"""WITH {GPANEL}, g AS (SELECT grp, epoch, period, row_number() OVER (PARTITION BY grp ORDER BY epoch, period) AS ord FROM (SELECT DISTINCT grp, epoch, period FROM gpanel)),
  e AS (SELECT p.grp, g.ord, entity, total FROM gpanel p JOIN g USING (grp, epoch, period)),
  last AS (SELECT t.grp, t.ord, e.entity, arg_max(e.total, e.ord) AS newest FROM g t JOIN e ON e.grp = t.grp AND e.ord BETWEEN t.ord - 8 AND t.ord - 1 GROUP BY 1, 2, 3)
  SELECT grp, ord, count(*) AS entities, round(avg(newest), 4) AS mean_newest FROM last GROUP BY 1, 2""")
def ordinal_lookback(spark, sf):
    p = grouped_panel(spark, sf)
    g = p.select("grp", *EP).distinct().withColumn("ord", F.row_number().over(W.ordered(["grp"], EP)).cast("long"))
    e = p.join(g, ["grp", *EP]).select("grp", "entity", "total", F.col("ord").alias("at"))
    # each source row serves the next 8 ordinals of its group: an equi join, bounded at 8 rows per source
    e = e.withColumn("ord", F.explode(F.sequence(F.col("at") + 1, F.col("at") + 8))).join(g.select("grp", "ord"), ["grp", "ord"])
    last = e.groupBy("grp", "ord", "entity").agg(F.max_by("total", "at").alias("newest"))
    return last.groupBy("grp", "ord").agg(F.count("*").alias("entities"), r(F.avg("newest")).alias("mean_newest"))


@q("top_prior_entity_flag", f"""WITH {GPANEL}, c AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM gpanel)
  SELECT grp, epoch, period, arg_max(entity, (round(prior, 2), -entity)) AS leader, bool_or(n > 1) AS any_busy FROM c GROUP BY 1, 2, 3""")
def top_prior_entity(spark, sf):
    c = W.trailing(grouped_panel(spark, sf), ["entity"], EP, None, {"prior": F.sum("total")})
    at = F.struct(F.round(F.coalesce("prior", F.lit(0.0)), 2), -F.col("entity"))
    return c.groupBy("grp", *EP).agg(F.max_by("entity", at).alias("leader"), F.bool_or(F.col("n") > 1).alias("any_busy"))


@q("spine_upcoming_rows", f"""WITH {PANEL}, nxt AS (SELECT entity, max(epoch) AS epoch, CAST(13 AS BIGINT) AS period FROM panel GROUP BY 1), s AS (SELECT entity, epoch, period, total FROM panel UNION ALL SELECT entity, epoch, period, NULL FROM nxt)
  SELECT entity, epoch, period, total, round(avg(total) OVER (PARTITION BY entity ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) AS mean_l4 FROM s""")
def upcoming(spark, sf):
    p = panel(spark, sf)
    nxt = p.groupBy("entity").agg(F.max("epoch").alias("epoch")).withColumn("period", F.lit(13).cast("long"))
    s = S.upcoming_rows(p.select(*KEY, "total"), nxt, KEY)
    return W.trailing(s, ["entity"], EP, 4, {"m": F.avg("total")}).select(*KEY, "total", r("m").alias("mean_l4"))


@q("spine_next_period", "SELECT o_custkey, min(o_orderdate) AS next_at FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def next_period(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("next_at"))


@q("spine_from_schedule", f"""WITH {GPANEL}, sched AS (SELECT DISTINCT grp, epoch, CAST(m AS BIGINT) AS period FROM gpanel CROSS JOIN (SELECT unnest(range(1, 13)) AS m)),
  tot AS (SELECT grp, epoch, period, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total FROM gpanel GROUP BY 1, 2, 3), s AS (SELECT * FROM sched LEFT JOIN tot USING (grp, epoch, period))
  SELECT grp, epoch, period, total, count(total) OVER w AS seen_l4, round(avg(total) OVER w, 3) AS mean_l4 FROM s WINDOW w AS (PARTITION BY grp ORDER BY epoch, period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def from_schedule(spark, sf):
    g = grouped_panel(spark, sf)
    tot = g.groupBy("grp", *EP).agg(money("total").alias("total"))
    sched = g.select("grp", "epoch").distinct().withColumn("period", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))))
    s = S.from_schedule(sched, tot, ["grp", *EP])
    return W.trailing(s, ["grp"], EP, 4, {"seen_l4": F.count("total"), "m": F.avg("total")}).select("grp", *EP, "total", "seen_l4", r("m", 3).alias("mean_l4"))


@q("sides_to_long", """SELECT o_orderkey, side, value, sign FROM (SELECT o_orderkey, 'home' AS side, o_custkey AS value, 1 AS sign FROM orders UNION ALL SELECT o_orderkey, 'away', o_custkey % 25, -1 FROM orders)""")
def to_long(spark, sf):
    k = F.col("o_custkey")
    return S.sides_to_long(table(spark, sf, "orders"), "o_orderkey", {"home": {"value": k, "sign": F.lit(1)}, "away": {"value": k % 25, "sign": F.lit(-1)}})


@q("resolve_unique_candidate", """SELECT p_name, CASE WHEN count(DISTINCT CASE WHEN p_size > 40 THEN p_partkey END) = 1 THEN max(CASE WHEN p_size > 40 THEN p_partkey END)
  WHEN count(DISTINCT CASE WHEN p_size > 20 THEN p_partkey END) = 1 THEN max(CASE WHEN p_size > 20 THEN p_partkey END) END AS resolved,
  CASE WHEN count(DISTINCT CASE WHEN p_size > 40 THEN p_partkey END) = 1 THEN 'strict' WHEN count(DISTINCT CASE WHEN p_size > 20 THEN p_partkey END) = 1 THEN 'loose' END AS level FROM part GROUP BY 1""")
def unique_candidate(spark, sf):
    levels = [("strict", F.col("p_size") > 40), ("loose", F.col("p_size") > 20)]
    return R.unique_candidate(table(spark, sf, "part"), ["p_name"], levels, "p_partkey")


@q("resolve_name_two_stage", """WITH known AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS name FROM part), asked AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part UNION SELECT DISTINCT p_name || ' ' || p_type FROM part),
  k1 AS (SELECT upper(name) AS k, max(id) AS i FROM known GROUP BY 1 HAVING count(DISTINCT id) = 1), k2 AS (SELECT left(upper(name), 1) || split_part(upper(name), ' ', 2) AS k, max(id) AS i FROM known GROUP BY 1 HAVING count(DISTINCT id) = 1)
  SELECT name, coalesce(k1.i, k2.i) AS resolved, CASE WHEN k1.i IS NOT NULL THEN 'exact' WHEN k2.i IS NOT NULL THEN 'loose' END AS method
  FROM asked LEFT JOIN k1 ON k1.k = upper(name) LEFT JOIN k2 ON k2.k = left(upper(name), 1) || split_part(upper(name), ' ', 2)""")
def name_two_stage(spark, sf):
    p = table(spark, sf, "part")
    known = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    asked = known.select("name").union(p.select(F.concat_ws(" ", "p_name", "p_type"))).distinct()
    up = F.upper("name")
    return R.two_stage(asked, known, up, F.concat(F.left(up, F.lit(1)), F.split_part(up, F.lit(" "), F.lit(2))), "id")


#: parts under the names that others give them: in capitals, with a letter missing, with a letter that is another, or by a nickname
ASKED = """known AS (SELECT p_partkey AS id, p_type AS class, p_size AS size, p_brand AS code, p_name || ' ' || p_brand AS name FROM part),
  asked AS (SELECT id AS row, class, size, id % 4 = 3 AS special, CASE id % 4 WHEN 0 THEN ' ' || upper(name) WHEN 1 THEN left(name, CAST(id % length(name) AS BIGINT)) || substr(name, id % length(name) + 2)
    WHEN 2 THEN left(name, CAST(id % length(name) AS BIGINT)) || 'x' || substr(name, id % length(name) + 2) ELSE split_part(name, ' ', 2) END AS name FROM known),
  nick AS (SELECT split_part(name, ' ', 2) AS nickname, min(code) AS code FROM known GROUP BY 1)"""


@q("resolve_exact_then_fuzzy", f"""WITH {ASKED}, k AS (SELECT *, lower(trim(name)) AS n FROM known), a AS (SELECT *, lower(trim(name)) AS n FROM asked),
  ex AS (SELECT class, size, n, max(id) AS e FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1),
  fz AS (SELECT row, max(k.id) AS f FROM a JOIN k USING (class, size) WHERE NOT special AND levenshtein(a.n, k.n) <= 2 GROUP BY 1 HAVING count(DISTINCT k.id) = 1),
  nk AS (SELECT row, max(k.id) AS i FROM a JOIN nick ON a.n = nick.nickname JOIN k ON k.code = nick.code AND k.class = a.class AND k.size = a.size WHERE special GROUP BY 1 HAVING count(DISTINCT k.id) = 1)
  SELECT row, CASE WHEN special THEN i ELSE coalesce(e, f) END AS resolved, CASE WHEN special THEN CASE WHEN i IS NOT NULL THEN 'nickname' END WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'fuzzy' END AS method
  FROM a LEFT JOIN ex USING (class, size, n) LEFT JOIN fz USING (row) LEFT JOIN nk USING (row)""")
def exact_then_fuzzy(spark, sf):
    p = table(spark, sf, "part")
    rows = p.count()
    known = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("class"), F.col("p_size").alias("size"), F.col("p_brand").alias("code"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    at = (F.col("id") % F.length("name")).cast("int")
    head, tail, kind = F.substr("name", F.lit(1), at), F.substr("name", at + 2), F.col("id") % 4
    name = F.when(kind == 0, F.concat(F.lit(" "), F.upper("name"))).when(kind == 1, F.concat(head, tail)).when(kind == 2, F.concat(head, F.lit("x"), tail)).otherwise(F.split_part("name", F.lit(" "), F.lit(2)))
    asked = known.select(F.col("id").alias("row"), "class", "size", (kind == 3).alias("special"), name.alias("name"))
    nick = known.groupBy(F.split_part("name", F.lit(" "), F.lit(2)).alias("nickname")).agg(F.min("code").alias("code"))
    out = fuzzy.resolve(asked, known, ["class", "size"], "name", "id", edits=2, special=F.col("special"), nicknames=nick, dealt=lambda df, *by: spread(df, 3 * rows, *by))
    return out.select("row", "resolved", "method")


@q("resolve_tiebreak_nearest", """SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(c_acctbal - s_acctbal), 2), s_suppkey) = 1""")
def tiebreak_nearest(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x"))
    return nearest_profiles(c, s, ["k"], ["x"], "c_custkey", "s_suppkey", 1, save).select("c_custkey", "s_suppkey")


@q("crosswalk_with_overrides", """WITH auto AS (SELECT c_custkey AS id, s_suppkey AS other FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey % 3 <> 0), manual AS (SELECT c_custkey AS id, c_custkey * 10 AS other FROM customer WHERE c_custkey < 30)
  SELECT id, other, 'auto' AS how FROM auto UNION ALL SELECT id, other, 'manual' FROM manual WHERE id NOT IN (SELECT id FROM auto)""")
def crosswalk(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    auto = c.where("c_custkey % 3 <> 0").join(s, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_custkey").alias("id"), F.col("s_suppkey").alias("other"))
    manual = c.where("c_custkey < 30").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 10).alias("other"))
    return auto.withColumn("how", F.lit("auto")).unionByName(manual.join(auto, "id", "left_anti").withColumn("how", F.lit("manual")))


@q("unmatched_report", f"""WITH {OBS} SELECT user_id, event_id, value FROM obs WHERE CAST(observed_at AS DATE) = (SELECT max(CAST(observed_at AS DATE)) FROM obs) AND user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def unmatched(spark, sf):
    o = observations(spark, sf).withColumn("day", F.to_date("observed_at"))
    newest = o.agg(F.max("day").alias("day"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return o.join(F.broadcast(newest), "day").join(s, "user_id", "left_anti").select("user_id", "event_id", "value")


@q("reconcile_keys", """SELECT coalesce(a, b) AS k, a IS NOT NULL AS in_left, b IS NOT NULL AS in_right FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT c_custkey AS b FROM customer WHERE c_acctbal > 0) ON a = b""")
def reconcile(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return R.reconcile_keys(a, b, ["k"])


SHOPPERS = """shoppers AS (SELECT c_custkey AS id, c_nationkey AS g, c_mktsegment AS segment, c_acctbal AS x1, CAST(count(o_orderkey) AS DOUBLE) AS x2, CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e5 AS x3, coalesce(max(o_totalprice), 0) AS y
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""


def shoppers(spark, sf):
    """Customers: balance, number of orders, their mean in 1e5 (null without any), and the largest as outcome."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), (money("o_totalprice") / F.count("*") / 1e5).alias("x3"), F.max("o_totalprice").alias("y"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("x1"))
    return c.join(o, "id", "left").select("id", "g", "segment", "x1", F.coalesce("n", F.lit(0)).cast("double").alias("x2"), "x3", F.coalesce("y", F.lit(0.0)).alias("y"))


_X = ("x1", "x2", "x3")


@q("nearest_match_control", f"""WITH RECURSIVE {SHOPPERS}, s AS (SELECT g, {", ".join(f"median({x}) AS m{x}, coalesce(nullif(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 0), 1) AS i{x}" for x in _X)} FROM shoppers GROUP BY 1),
  z AS MATERIALIZED (SELECT id, g, y, segment = 'MACHINERY' AS t, {", ".join(f"coalesce(({x} - m{x}) / i{x}, 0) AS {x}" for x in _X)} FROM shoppers JOIN s USING (g)),
  t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS i FROM z WHERE t),
  m AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS treated, CAST(NULL AS BIGINT) AS control, CAST(NULL AS DOUBLE) AS far, CAST(NULL AS DOUBLE) AS delta FROM t
    UNION ALL SELECT g, i, list_append(used, control), treated, control, far, delta FROM (
      SELECT m.g, t.i, m.used, t.id AS treated, c.id AS control, round({" + ".join(f"pow(t.{x} - c.{x}, 2)" for x in _X)}, 9) AS far, t.y - c.y AS delta,
        row_number() OVER (PARTITION BY m.g ORDER BY round({" + ".join(f"pow(t.{x} - c.{x}, 2)" for x in _X)}, 9), c.id) AS k
      FROM m JOIN t ON t.g = m.g AND t.i = m.i + 1 JOIN z c ON c.g = m.g AND NOT c.t AND NOT list_contains(m.used, c.id)) WHERE k = 1)
  SELECT treated, control, round(far / 3, 6) AS distance, round(delta, 2) AS outcome_delta FROM m WHERE i > 0""")
def match_control(spark, sf):
    c = shoppers(spark, sf).withColumn("t", F.col("segment") == "MACHINERY")
    out = match_once(c, ["g"], list(_X), "id", "t", save)
    y = c.select("id", "y")
    out = out.join(y.select(F.col("id").alias("treated"), F.col("y").alias("a")), "treated").join(y.select(F.col("id").alias("control"), F.col("y").alias("b")), "control")
    return out.select("treated", "control", r("distance", 6).alias("distance"), r(F.col("a") - F.col("b"), 2).alias("outcome_delta"))


@q("pairwise_min_distance", f"""WITH {FACTS}, a AS (SELECT basket, line, flag, qty, disc FROM facts) SELECT x.basket, x.line, round(min(sqrt(pow(x.qty - y.qty, 2) + pow(100 * (x.disc - y.disc), 2))), 6) AS nearest
  FROM a x JOIN a y ON x.basket = y.basket AND x.flag <> y.flag GROUP BY 1, 2""")
def pairwise_min(spark, sf):
    a = facts(spark, sf).select("basket", "line", "flag", "qty", "disc")
    b = a.select("basket", F.col("flag").alias("f2"), F.col("qty").alias("q2"), F.col("disc").alias("d2"))
    far = F.sqrt(F.pow(F.col("qty") - F.col("q2"), 2) + F.pow(100 * (F.col("disc") - F.col("d2")), 2))
    return a.join(b, "basket").where("flag <> f2").groupBy("basket", "line").agg(r(F.min(far), 6).alias("nearest"))


@q("fan_out_guard", "SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def fan_out(spark, sf):
    return R.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])
