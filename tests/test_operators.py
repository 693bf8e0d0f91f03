"""Operators on small inputs with planted faults, ties, gaps, nulls and empty tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pitpanel.functions import exprs as X
from pitpanel.operators import asof as A
from pitpanel.operators import baskets as B
from pitpanel.operators import evaluate as V
from pitpanel.operators import gates as G
from pitpanel.operators import resolve as R
from pitpanel.operators import series as S
from pitpanel.operators import spine as SP
from pitpanel.operators import windows as W
from pitpanel.plans import registry
from pitpanel.sources import tables as T
from pitpanel.streaming import jobs as J

PANEL = "entity long, period long, x double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(7)
    data = [(e, p, None if rng.random() < 0.2 else float(rng.randrange(100))) for e in range(20) for p in range(1, 11) if rng.random() < 0.9]
    return spark.createDataFrame(data, PANEL)


def test_gate_passes_the_correct_build_and_rejects_the_leaky_one(source):
    good = W.trailing(source, ["entity"], ["period"], 4, {"f": F.avg("x")})
    leaky = W.trailing(source, ["entity"], ["period"], 4, {"f": F.avg("x")}, inclusive=True)
    check = lambda built: G.no_leakage(built.drop("x"), source, ["entity"], ["period"], "f", "x", 4)
    G.require_none(check(good), "no_leakage")
    with pytest.raises(G.LeakageError):
        G.require_none(check(leaky), "no_leakage")
    nulls = good.withColumn("f", F.coalesce("f", F.lit(0.0)))  # zero where nothing was known is a leak of its own
    assert check(nulls).count() > 0
    shuffled = good.orderBy(F.rand(1)).repartition(3)
    assert check(shuffled).count() == 0


def test_other_gates(spark, source):
    good = W.trailing(source, ["entity"], ["period"], 4, {"f": F.avg("x")})
    assert G.first_row_null(good, ["entity"], ["period"], ["f"]).count() == 0
    assert G.first_row_null(good, ["entity"], ["period"], ["period"]).count() == 20
    bad = G.recompute_match(good.where("entity > 0").withColumn("f", F.when(F.col("entity") != 1, F.col("f"))), good, ["entity", "period"], ["f"], 1e-9)
    assert {r.why for r in bad.collect()} == {"missing", "null"}
    contract = {r.rule: r.violations for r in G.frame_contract(good, {"period": F.col("period") > 1, "key": F.col("entity").isNotNull()}).collect()}
    assert contract["key"] == 0 and contract["period"] > 0
    assert R.duplicates(spark.createDataFrame([(1,), (1,), (None,)], "k long"), ["k"]).count() == 1


def test_asof_ties_and_bounds(spark):
    s = spark.createDataFrame([(1, 5, None), (1, 3, 30.0), (2, 1, 1.0)], PANEL).withColumnRenamed("x", "v")
    t = spark.createDataFrame([(1, 5, 0.0), (1, 3, 0.0), (1, 6, 0.0), (2, 1, 0.0), (3, 9, 0.0)], PANEL)
    strict = {(r.entity, r.period): r.asof_v for r in A.asof(t, s, ["entity"], ["period"], ["v"]).collect()}
    assert strict == {(1, 5): 30.0, (1, 3): None, (1, 6): None, (2, 1): None, (3, 9): None}  # the newest row is null and stays so
    loose = {(r.entity, r.period): r.asof_v for r in A.asof(t, s, ["entity"], ["period"], ["v"], strict=False).collect()}
    assert loose == {(1, 5): None, (1, 3): 30.0, (1, 6): None, (2, 1): 1.0, (3, 9): None}
    assert A.asof(t.limit(0), s, ["entity"], ["period"], ["v"]).count() == 0
    assert A.asof(t, s.limit(0), ["entity"], ["period"], ["v"]).where("asof_v is not null").count() == 0


def test_lookback_counts_the_calendar_not_rows(spark):
    p = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 9, 9.0)], PANEL)
    got = {r.period: r.n for r in A.lookback(p, ["entity"], "period", 4, {"n": F.count("*")}).collect()}
    assert got == {1: 0, 2: 1, 9: 0}


def test_windows_on_odd_panels(spark, source):
    for df in (source.limit(0), source.limit(1), source.withColumn("x", F.lit(None).cast("double"))):
        out = W.latest_vs_rest(W.gated_sum(df, ["entity"], ["period"], 4, "x", 2, "s"), ["entity"], ["period"], 4, "x", "j")
        assert out.where("s is not null or j is not null").count() == 0
    ranked = W.rank_pct(spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, None), (1, 4, 9.0)], PANEL), ["entity"], "x", "r")
    assert {r.period: r.r for r in ranked.collect()} == {1: 0.5, 2: 0.5, 3: None, 4: 1.0}


def test_spines(spark):
    p = spark.createDataFrame([(1, 1, 1.0)], PANEL)
    up = SP.upcoming_rows(p, spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "entity long, period long"), ["entity", "period"])
    assert rows(up) == [(1, 1, 1.0), (1, 2, None)]


def test_resolution(spark):
    known = spark.createDataFrame([(1, "ANN LEE"), (2, "ANN LEE"), (3, "BOB RAY")], "id long, name string")
    asked = spark.createDataFrame([("ANN LEE",), ("BOB RAY",), ("BEN RAY",), (None,)], "name string")
    loose = F.concat(F.left("name", F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2)))
    got = {r.name: (r.resolved, r.method) for r in R.two_stage(asked, known, F.col("name"), loose, "id").collect()}
    assert got == {"ANN LEE": (None, None), "BOB RAY": (3, "exact"), "BEN RAY": (3, "loose"), None: (None, None)}


def test_expressions(spark):
    df = spark.createDataFrame([(None, -110.0), (2.0, 150.0)], "a double, p double")
    got = rows(df.select(X.mean_nonnull("a"), F.round(X.implied_probability(F.col("p")), 4), X.blend(F.col("p"), F.col("a"), 0.5)))
    assert got == sorted([(None, 0.5238, -110.0), (2.0, 0.4, 76.0)], key=str)
    assert df.select(X.row_hash("a")).distinct().count() == 2


def test_pairs_and_cover(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (2, 1), (3, 3)], "basket long, item long")
    assert rows(B.pair_counts(items, "basket", "item", 10)) == [(1, 2, 2)]
    with pytest.raises(Exception, match="over 1 items"):
        B.pair_counts(items, "basket", "item", 1).collect()
    assert [tuple(r) for r in B.greedy_cover(items, "basket", "item", 5, T.save).orderBy("step").collect()] == [(1, 1, 2), (2, 3, 1)]
    assert B.greedy_cover(items.limit(0), "basket", "item", 2, T.save).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 2.0)], "k long, v double, y double")
    assert V.sample_crps(df, ["k"], "v", "y").first().crps == pytest.approx(0.5)
    assert S.normal_crps(0.0, 0.0, 1.0) == pytest.approx(0.2336949772)
    assert S.cusum([0, 0, 0, 0, 9, 9, 9], 0.5, 1.0)[5] and not any(S.cusum([1, 1, 1], 0.5, 1))
    assert S.cusum([9, 9, 9, 9, 0, 0, 0], 0.5, 1.0)[5] and not any(S.cusum([0, 9] * 6, 0.5, 4.0))
    p = S.changepoint_probability([1, 1.1, 0.9, 1, 1.05, 0.95, 1, 9, 9.1, 8.9, 9, 9.05])
    assert p[6] < 0.5 < max(p[7:10]) and p[:5] == [0.0] * 5 and all(0 <= x <= 1 + 1e-9 for x in p) and not math.isnan(sum(p))
    assert S.changepoint_probability([]) == [] and sum(S.changepoint_probability([3.0] * 4)) == 0


def test_global_rank_in_cut_ranges(spark):
    """Many ranges, sizes that tempt Spark to merge some of them, and a wide column that one of the uses leaves out."""
    from pyspark.sql import Window

    from pitpanel.plans.baskets_plans import global_rank
    from pitpanel.plans.evaluate_plans import _order_statistic

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(400_000).select(F.col("id").alias("basket"), (F.xxhash64("id") % 100_000).alias("price"), F.repeat(F.lit("x"), 40).alias("wide"))
        got = global_rank(df, "price").select("basket", "rnk")
        want = df.select("basket", F.rank().over(Window.orderBy(F.desc("price"))).alias("direct"))
        both = got.join(want, "basket")
        assert (both.count(), both.where("rnk <> direct").count()) == (400_000, 0)
        s = df.select(F.col("price").alias("s"))
        every = sorted(r[0] for r in s.collect())
        assert _order_statistic(s, s.agg(F.count("*").alias("n"))).first()[0] == every[math.ceil(400_001 * 0.8) - 1]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_nearest(spark):
    """Ties, equal values, few peers and empty pools, against all pairs."""
    import random

    from pitpanel.operators.nearest import nearest

    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.randrange(12), i) for i in range(160)] + [(9, 1, 999)]
    df = spark.createDataFrame(rows, "g long, x long, id long")
    got = {(r.id, r.place, r.peer) for r in nearest(df, df, ["g"], "x", ["id"], "id", 3).collect()}
    want = set()
    for g, x, i in rows:
        near = sorted((abs(x - y), j) for h, y, j in rows if h == g and j != i)[:3]
        want |= {(i, k + 1, j) for k, (_, j) in enumerate(near)}
    assert got == want
    assert nearest(df, df.limit(0), ["g"], "x", ["id"], "id", 3).count() == 0


def test_shared_items(spark):
    """An item of every basket, baskets of one item and equal baskets, against all pairs."""
    import random

    rng = random.Random(6)
    sets = {b: {0} | {int(rng.paretovariate(0.6)) % 50 for _ in range(rng.randrange(8))} for b in range(80)}
    sets[80] = sets[7]
    df = spark.createDataFrame([(b, i) for b, s in sets.items() for i in s for _ in range(2)], "basket long, item long")
    for least in (2, 3):
        want = {(a, b, n) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) >= least}
        assert {tuple(r) for r in B.shared_items(df, "basket", "item", least).collect()} == want


def test_shared_items_brings_no_candidates(spark):
    """A frequent item brought every pair of its baskets, which then were shuffled; and baskets too large for pairs of items."""
    from itertools import combinations

    rows = [(b, i) for b in range(400) for i in (b % 2, 2 + b)] + [(500 + b, i) for b in range(3) for i in [*range(1000, 1006 + b), 0]] + [(None, 0), (None, 1000), (7, None), (8, None)]
    df = spark.createDataFrame(rows, "basket long, item long")
    sets = {b: {i for x, i in rows if x == b and i is not None} for b, _ in rows if b is not None}
    for least, most in ((1, 64), (1, 2), (2, 64), (2, 6), (2, 1), (3, 7)):
        want = {(a, b, n) for a, b in combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) >= least}
        got = B.shared_items(df, "basket", "item", least, T.save, most=most)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    out = B.shared_items(df, "basket", "item", 2, T.save)
    assert "array_intersect" not in out._jdf.queryExecution().toString()  # no pair is joined to its sets again


def test_tables(spark):
    path = T.workspace(spark)
    df = spark.range(5)
    assert T.append_batch(df, path, "b") is True
    assert T.append_batch(df, path, "b") is False
    with pytest.raises(T.ConflictError):
        T.append_batch(spark.range(6), path, "b")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError, match="x"):
        T.render("a ${x}")
    fresh, clash = T.novel(spark.range(3).withColumn("v", F.lit(None).cast("int")), spark.range(1).withColumn("v", F.lit(1)), ["id"], ["v"])
    assert (fresh.count(), clash.count()) == (2, 1)


def test_conformal_step():
    alpha, window = 0.1, []
    for i in range(300):
        alpha, bound, missed = J.conformal_step(alpha, window, float(i % 10), 0.1, 0.02, 50)
    assert len(window) == 50 and 0 < alpha <= 0.5 and bound is not None and missed in (True, False)


def test_row_order_changes_nothing(spark, tmp_path):
    from conftest import SF, rows_of

    found, _ = registry.collect()
    for t in ("orders", "customer"):
        spark.read.parquet(f"{SF}/{t}.parquet").orderBy(F.rand(3)).repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("win_trailing_n_prior", "win_consensus_rank", "join_asof_strict_period", "agg_shrunk_rate"):
        a, b = found[name](spark, SF), found[name](spark, str(tmp_path))
        assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.collect()), name


def test_cusum_and_changepoint_panels(spark):
    """The registered queries against a plain reading of each entity's series."""
    from collections import defaultdict

    from conftest import SF

    found = registry.collect()[0]
    totals = defaultdict(dict)
    for o in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(20,4)").alias("v")).collect():
        key = (o.o_orderdate.year, o.o_orderdate.month)
        totals[o.o_custkey][key] = totals[o.o_custkey].get(key, 0) + o.v
    want = {}
    for e, months in totals.items():
        at = sorted(months)
        x = [float(months[m]) / 1e5 for m in at]
        if len(x) < 3:
            continue
        mean = sum(x) / len(x)
        sd = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        up = down = 0.0
        for m, v in zip(at, x):
            z = (v - mean) / sd if sd else 0.0
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            flag = up > 1.5 or down > 1.5
            want[e, m[0] * 12 + m[1]] = flag
            if flag:
                up = down = 0.0
    got = {(r.entity, r.at): r.cusum_flag for r in found["cusum_panel"](spark, SF).collect()}
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in got) <= 1 and any(want.values())
    p = found["changepoint_panel"](spark, SF).collect()
    assert {r.entity for r in p} == {e for e, m in totals.items() if len(m) >= 4} and all(0 <= r.p_change <= 1 + 1e-9 for r in p)


def test_online_conformal_query(spark):
    """Against the same recursion in plain Python over the stream's three files."""
    from conftest import SF

    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").cast("double").alias("t")).collect()
    low, high = min(r.t for r in rows), max(r.t for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: (min(int((r.t - low) / (high - low) * 3), 2), r.event_id)):
        by.setdefault(r.event_type, []).append(r)
    got = {r.at: r for r in registry.collect()[0]["stream_online_conformal"](spark, SF).collect()}
    assert len(got) == len(rows)
    merged = sum(len(v) for v in by.values())
    assert merged == len(rows)
    for own in by.values():
        for order in (own, sorted(own, key=lambda r: r.event_id)):  # files may share a micro-batch
            alpha, scores, same = 0.1, [], True
            for r in order:
                bound = sorted(scores)[min(len(scores), max(1, math.ceil((len(scores) + 1) * (1 - alpha)))) - 1] if scores else None
                missed = bound is not None and r.value > bound
                g = got[r.event_id]
                same &= g.missed == missed and g.alpha == pytest.approx(alpha) and (g.bound is None) == (bound is None) and (bound is None or g.bound == bound)
                scores = [*scores, r.value][-200:]
                alpha = min(0.5, max(0.001, alpha + 0.02 * (0.1 - missed)))
            if same:
                break
        assert same


def test_conformal_rows_hold_one_batch():
    """A key's whole micro-batch was held by a task; now rows pass through, states before and after them."""
    import pyarrow as pa

    rows = [("a", None, None, 0.2, [5.0, 1.0, 3.0])] + [(k, i, float((i * 7) % 13), None, None) for k in "ab" for i in range(300)]
    kinds = pa.schema([("key", pa.string()), ("at", pa.int64()), ("score", pa.float64()), ("alpha", pa.float64()), ("scores", pa.list_(pa.float64()))])
    taken = []

    def batches():
        for i in range(0, len(rows), 10):
            taken.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[i : i + 10], strict=True), kinds, strict=True)], schema=kinds)

    out = J.conformal_rows(batches(), 0.1, 0.02, 50)
    got = next(out).to_pylist()
    assert len(taken) == 1
    got += [r for b in out for r in b.to_pylist()]
    want = []
    for k, alpha, window in (("a", 0.2, [5.0, 1.0, 3.0]), ("b", 0.1, [])):
        for i in range(300):
            used = alpha
            alpha, bound, missed = J.conformal_step(alpha, window, float((i * 7) % 13), 0.1, 0.02, 50)
            want.append({"key": k, "at": i, "bound": bound, "missed": missed, "alpha": used, "scores": None})
        want.append({"key": k, "at": None, "bound": None, "missed": None, "alpha": alpha, "scores": window})
    assert sorted(got, key=lambda r: (r["key"], r["at"] is None, r["at"])) == want
