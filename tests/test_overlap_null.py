"""The largest overlap and the shared pairs of a target set, and both under independence, against plain Python."""

import hashlib
import itertools

import numpy as np
import pytest

from pitpanel.operators import baskets as B
from pitpanel.plans import registry


def told(spark, baskets, target, reps=500):
    rows = [(b, i) for b, s in enumerate(baskets) for i in s if i in target]
    hits = spark.createDataFrame(rows, "b long, i long")
    book = spark.createDataFrame([(len(baskets), max(len(target & set(s)) for s in baskets))], "entries long, max_overlap long")
    return B.overlap_null(hits, B.pair_counts(hits, "b", "i", 100), book, "i", reps, "7").first()


def test_overlap_null(spark):
    rng = np.random.default_rng(4)
    baskets, target = [set(rng.integers(0, 30, rng.integers(1, 6)).tolist()) | {99} for _ in range(80)], {*range(9), 99}
    got, n = told(spark, baskets, target), len(baskets)
    items = sorted(i for i in target if any(i in s for s in baskets))
    e = [sum(i in s for s in baskets) / n for i in items]
    q = np.array([1.0])
    for x in e:
        q = np.convolve(q, [1 - x, x])
    f = np.cumsum(q) ** n
    draws = [min(len(items), int(np.searchsorted(f, int(hashlib.md5(f"7|{k}".encode()).hexdigest()[:13], 16) / 2**52, "right"))) for k in range(500)]
    assert (got.entries, got.coverage, got.max_overlap) == (n, len(items), max(len(target & s) for s in baskets))
    assert got.null_max_mean == pytest.approx(np.mean(draws), abs=1e-9)
    assert [got.null_max_q05, got.null_max_q95] == pytest.approx(list(np.quantile(draws, [0.05, 0.95])))
    assert got.max_minus_null == pytest.approx(got.max_overlap - np.mean(draws))
    # the same null drawn item by item
    drawn = (rng.random((2000, n, len(items))) < np.array(e)).sum(axis=2).max(axis=1)
    assert got.null_max_mean == pytest.approx(drawn.mean(), abs=0.1)
    pairs = list(itertools.combinations(range(len(items)), 2))
    assert got.pair_any_rate == pytest.approx(np.mean([any({items[a], items[b]} <= s for s in baskets) for a, b in pairs]))
    assert got.pair_independent_rate == pytest.approx(np.mean([1 - (1 - e[a] * e[b]) ** n for a, b in pairs]))


def test_overlap_null_odd(spark):
    none = told(spark, [{1}, {2}], {7})
    assert (none.entries, none.coverage, none.max_overlap, none.null_max_mean, none.pair_any_rate) == (2, 0, 0, None, None)
    one = told(spark, [{1}], {1})
    assert (one.coverage, one.max_overlap, one.null_max_mean, one.pair_any_rate, one.pair_independent_rate) == (1, 1, 1.0, None, None)


def test_query_has_the_whole_method(spark):
    out = registry.collect()[0]["set_overlap_vs_null"](spark, "/root/testdata/sf0.001")
    assert {"max_overlap", "null_max_mean", "pair_any_rate", "pair_independent_rate"} <= set(out.columns)
