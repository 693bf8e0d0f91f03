"""Swaps into a picked set and subgroup discovery against exhaustive plain Python."""

from __future__ import annotations

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pitpanel.operators.baskets import balanced_effects, pair_lift, swap_frontier
from pitpanel.operators.subgroups import discover
from pitpanel.sources.tables import save


def swaps(sets, picked):
    """basket -> (new events, best change, swaps that lose nothing), every swap tried."""
    events = collections.defaultdict(set)
    for b, e in sets:
        if b is not None and e is not None:
            events[b].add(e)
    picked = sorted({p for p in picked if p is not None})
    now = set().union(*[events[p] for p in picked])
    out = {}
    for b in [b for b in events if events[b]]:
        after = [set().union(events[b], *[events[p] for p in picked if p != gone]) for gone in picked]
        deltas = [len(a) - len(now) for a in after]
        out[b] = (len(events[b] - now), max(deltas), sum(d >= 0 for d in deltas))
    return out


@pytest.mark.parametrize(("events", "size"), [(6, 2), (30, 3), (200, 5)])
def test_swap_frontier(spark, events, size):
    rng = random.Random(events)
    sets = [(b, min(rng.randrange(events), rng.randrange(events))) for b in range(40) for _ in range(rng.randrange(1, size + 1))]
    picked = [rng.randrange(40) for _ in range(6)] + [0, 0, 99]  # repeated, and one without events
    sets += [*sets[:5], (None, 1), (3, None), (50, 0)]
    got = swap_frontier(spark.createDataFrame(sets, "b long, e long"), spark.createDataFrame([(p,) for p in [*picked, None]], "b long"), "b", "e").collect()
    assert {r.b: (r.new_events, r.best_delta, r.free_swaps) for r in got} == swaps(sets, picked)


def test_swap_frontier_without_rows(spark):
    none, some = spark.createDataFrame([], "b long, e long"), spark.createDataFrame([(1, 1)], "b long, e long")
    assert swap_frontier(none, none.select("b"), "b", "e").collect() == []
    assert swap_frontier(some, none.select("b"), "b", "e").collect() == []  # there is nothing to swap


def best_rules(rows, names, beam, depth, least, keep):
    """(clauses, support, positives) of the search, every conjunction of each level counted."""
    rows = [(r, h) for r, h in rows if h is not None]
    n, p = len(rows), sum(h for _, h in rows)
    key = lambda x: (-(x[2] * n - x[1] * p), -(x[2] / x[1]), x[0])
    low, frontier, found = max(least, math.ceil(n * 0.001)), {()}, []
    for _ in range(depth):
        count = collections.Counter()
        for r, h in rows:
            has = sorted(f"{c}={v}" for c, v in zip(names, r, strict=True) if v is not None)
            for size in {len(f) + 1 for f in frontier}:
                for cs in itertools.combinations(has, size):
                    if any(cs[:i] + cs[i + 1 :] in frontier for i in range(size)):
                        count[cs, 0] += 1
                        count[cs, 1] += h
        level = [(cs, s, count[cs, 1]) for (cs, k), s in count.items() if k == 0 and s >= low and count[cs, 1] * n > s * p]
        level = sorted(level, key=key)[:beam]
        found += level
        frontier = {cs for cs, _, _ in level}
    return sorted(found, key=key)[:keep]


@pytest.mark.parametrize(("beam", "depth", "least", "keep"), [(10**4, 3, 1, 10**4), (24, 3, 20, 25), (3, 4, 5, 6), (1, 2, 5, 3)])
def test_discover(spark, beam, depth, least, keep):
    rng = random.Random(2)
    names, rows = ["color", "size", "Form", "n"], []
    for _ in range(600):
        v = (rng.choice("rgb"), rng.choice(["s", "m", None]), rng.choice(["a=b", "c", "d"]), rng.randrange(4))
        hit = rng.random() < 0.1 + 0.5 * (v[0] == "r" and v[2] == "c") + 0.3 * (v[3] == 2)
        rows.append((v, None if rng.random() < 0.02 else int(hit)))
    df = spark.createDataFrame([(*v, h) for v, h in rows], "color string, size string, Form string, n long, hit int")
    got = discover(df, names, "hit", save, beam=beam, depth=depth, least=least, keep=keep).orderBy("rank").collect()
    assert [(tuple(r.clauses), r.support, r.positive_rows) for r in got] == best_rules(rows, names, beam, depth, least, keep)
    n, p = sum(h is not None for _, h in rows), sum(h or 0 for _, h in rows)
    for r in got:
        assert r.lift == pytest.approx(r.positive_rows / r.support / (p / n)) and r.wracc == pytest.approx(r.support / n * (r.positive_rate - p / n))


def test_discover_finds_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), (None, None)], "c string, hit int")
    assert discover(df, ["c"], "hit", save).collect() == []
    assert discover(df.where(F.lit(False)), ["c"], "hit", save).collect() == []
    every = spark.createDataFrame([("a", 1)] * 30, "c string, hit int")
    assert discover(every, ["c"], "hit", save).collect() == []  # no rate is above the base rate


def test_pair_lift(spark):
    rng = random.Random(6)
    sets = {b: {rng.randrange(9) for _ in range(rng.randrange(1, 5))} for b in range(80)}
    hit = {b: int(3 in s or rng.random() < 0.1) for b, s in sets.items()}
    items = spark.createDataFrame([(b, i) for b, s in sets.items() for i in s for _ in range(1 + b % 2)], "b long, i long")
    got = pair_lift(items, spark.createDataFrame(list(hit.items()), "b long, hit long"), "b", "i", 10, 3).collect()
    base, seen = sum(hit.values()) / len(hit), {}
    for x, y in itertools.combinations(range(9), 2):
        own = [b for b, s in sets.items() if {x, y} <= s]
        if len(own) >= 3:
            high = sum(hit[b] for b in own)
            rate = (high + 1) / (len(own) + 2)
            seen[x, y] = (len(own), high, rate, rate / base, math.log2(rate / base) * math.sqrt(high))
    assert {(r.item_a, r.item_b): pytest.approx((r.together, r.high, r.rate, r.lift, r.priority)) for r in got} == seen


def test_balanced_effects(spark):
    rng = random.Random(1)
    cells = [(a, p, rng.random() + a * 2 + p) for a in range(3) for p in range(7)]
    rows = spark.createDataFrame([*cells, (0, 50, 9.0), (1, 50, 3.0)], "a long, p long, v double")  # a period without every arm
    got = {r.a: r for r in balanced_effects(rows, "a", "p", "v", 3).collect()}
    mean = lambda k, i: sum(c[2] for c in cells if c[i] == k) / sum(c[i] == k for c in cells)
    grand = sum(c[2] for c in cells) / len(cells)
    ss = sum((v - mean(a, 0) - mean(p, 1) + grand) ** 2 for a, p, v in cells)
    for a in range(3):
        assert got[a].effect == pytest.approx(mean(a, 0) - grand) and got[a].df == 12
        assert got[a].residual_variance == pytest.approx(ss / 12)
        assert got[a].t == pytest.approx(got[a].effect / math.sqrt(ss / 12 * (2 / 3) / 7))
