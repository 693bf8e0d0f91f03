"""Ranks, running sums and quantiles by ranges against plain Python, over many cuts, ties, nulls and one hot group."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import ranks as K
from pitpanel.sources.tables import save

SCHEMA = "id long, g string, h long, x double, w long, hit int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(700):
        g = rng.choice(["a", "a", "a", "a", "b", None])
        out.append((i, g, rng.randrange(2), rng.choice([None, 1.5, 1.5, 1.5, rng.random(), rng.gauss(0, 3)]), rng.randrange(5), rng.randrange(2)))
    return out


@pytest.fixture(params=[2, 37])
def df(spark, rows, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, SCHEMA).repartition(5)
    for k, v in before.items():
        spark.conf.set(k, v)


def groups(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[1], r[2]].append(r)
    return out


def up(x):
    return -math.inf if x is None else x


def test_running_and_numbered(df, rows):
    got = {r.id: r for r in K.running(df, ["g", "h"], ["x", "id"], {"sum_w": "w", "hits": "hit"}, save).collect()}
    placed = {r.id: (r.place, r.place_all) for r in K.numbered(df, ["g", "h"], ["x", "id"], save).collect()}
    everyone = {r.id: r.place for r in K.numbered(df, [], [F.desc("x"), "id"], save).collect()}
    assert len(got) == len(placed) == len(rows)
    for own in groups(rows).values():
        w = hits = 0
        for k, r in enumerate(sorted(own, key=lambda r: (up(r[3]), r[0])), 1):
            w, hits = w + r[4], hits + r[5]
            assert (got[r[0]].sum_w, got[r[0]].hits) == (w, hits) and placed[r[0]] == (k, len(own))
            assert got[r[0]].sum_w_all == sum(x[4] for x in own)
    assert [i for i, _ in sorted(everyone.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (-up(r[3]), r[0]))]


def test_ranked_and_bands(df, rows):
    for down in (False, True):
        got = {r.id: (r["rank"], r.rank_ties, r.rank_all) for r in K.ranked(df, ["g", "h"], "x", save, down=down).collect()}
        for own in groups(rows).values():
            for r in own:
                before = sum((up(y[3]) > up(r[3])) if down else (up(y[3]) < up(r[3])) for y in own)
                assert got[r[0]] == (before + 1, sum(y[3] == r[3] for y in own), len(own))
    band = {r.id: r.band for r in K.bands(df, ["g"], ["x", "id"], 7, "band", save).collect()}
    mean = {r.id: r.m for r in K.mean_rank(df, ["g"], "x", "m", save).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    for own in by.values():
        for k, r in enumerate(sorted(own, key=lambda r: (up(r[3]), r[0]))):
            assert band[r[0]] == k * 7 // len(own)
            low = sum(up(y[3]) < up(r[3]) for y in own)
            assert mean[r[0]] == low + 1 + (sum(y[3] == r[3] for y in own) - 1) / 2


def test_quantiles(df, rows):
    at = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {(r.g, r.h): [r[c] for c in at] for r in K.quantiles(df, ["g", "h"], "x", at, save).collect()}
    for key, own in groups(rows).items():
        assert got[key] == pytest.approx(np.quantile([r[3] for r in own if r[3] is not None], list(at.values())))
    one = K.quantiles(df, [], "x", at, save).first()
    assert list(one) == pytest.approx(np.quantile([r[3] for r in rows if r[3] is not None], list(at.values())))
    weighted = K.weighted_quantiles(df.where("w > 0"), ["g"], "x", "w", {"q": 0.3}, save).collect()
    for r in weighted:
        assert r.q == pytest.approx(np.quantile([x[3] for x in rows if x[1] == r.g and x[3] is not None for _ in range(x[4])], 0.3))


def test_rank_quality(df, rows):
    got = {r.g: (r.ap, r.ndcg) for r in K.rank_quality(df, ["g"], "x", ["id"], "hit", save).collect()}
    for g in {r[1] for r in rows}:
        hits = [r[5] for r in sorted([r for r in rows if r[1] == g], key=lambda r: (-up(r[3]), r[0]))]
        ap = sum(sum(hits[: k + 1]) / (k + 1) for k, h in enumerate(hits) if h) / sum(hits)
        gain = lambda hs: sum(h / math.log2(k + 2) for k, h in enumerate(hs))
        assert got[g] == pytest.approx((ap, gain(hits) / gain(sorted(hits, reverse=True))))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert K.numbered(none, ["g"], ["x", "id"], save).collect() == K.ranked(none, ["g"], "x", save).collect() == []
    assert K.quantiles(none, ["g"], "x", {"q": 0.5}, save).collect() == []
    assert [tuple(r) for r in K.quantiles(none, [], "x", {"q": 0.5}, save).collect()] == [(None,)]


def test_discrimination(df, rows):
    got = {r.g: (r.roc_auc, r.average_precision) for r in K.discrimination(df, ["g"], "x", "hit", save).collect()}
    for g in {r[1] for r in rows}:
        own = [(r[3], r[5]) for r in rows if r[1] == g and r[3] is not None]
        pos, neg = [x for x, h in own if h], [x for x, h in own if not h]
        auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        ap = sum(sum(y == p for y in pos) / len(pos) * sum(y >= p for y in pos) / sum(y >= p for y, _ in own) for p in set(pos))
        assert got[g] == pytest.approx((auc, ap))


def test_discrimination_of_one_class(spark):
    one = spark.createDataFrame([(1, "a", 0, 1.0, 1, 1), (2, "a", 0, 2.0, 1, 1), (3, "b", 0, 2.0, 1, 0)], SCHEMA)
    assert {r.g: (r.roc_auc, r.average_precision) for r in K.discrimination(one, ["g"], "x", "hit", save).collect()} == {"a": (None, None), "b": (None, None)}


def test_placed_in_one_pass(spark):
    """Places, sums and mean ranks took a range sort each; ties are put in order by others, and have the mean of their ranks."""
    rng, saved = random.Random(3), []
    rows = [(rng.choice("pq"), float(rng.randrange(12)), i, rng.randrange(2)) for i in range(300)] + [("alone", 1.0, 900, 1)]
    df = spark.createDataFrame(rows, "g string, x double, id long, hit int").repartition(5)
    counted = lambda d: saved.append(1) or save(d)
    out = K.placed(df, ["g"], "x", ["id"], counted, place="k", mean="m", sums={"hits": "hit"})
    got = {r.id: (r.k, r.k_all, r.m, r.hits) for r in out.collect()}
    for g, x, i, _ in rows:
        own = sorted((-y, j, h) for q, y, j, h in rows if q == g)
        k = next(n for n, o in enumerate(own, 1) if o[1] == i)
        low, ties = sum(-y < x for y, *_ in own), sum(-y == x for y, *_ in own)
        assert got[i] == (k, len(own), low + (ties + 1) / 2, sum(h for *_, h in own[:k]))
    assert len(saved) == 1
