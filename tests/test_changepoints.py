"""Change probabilities of many series at once, and p by midpoints, against one after the other."""

import math
import random

import numpy as np
import pytest

from pitpanel.operators import series as SE


def test_many_series_as_one_by_one():
    rng = random.Random(3)
    series = [np.array([rng.gauss(i % 3 * (t > 9), 0.1 + i % 2) for t in range(n)]) for i, n in enumerate([0, 1, 4, 5, 9, 30, 30, 77, 120])]
    series += [np.full(20, 3.0), np.array([1.0] * 12 + [9.0] * 12)]
    got = SE.changepoint_probabilities(series)
    for x, p in zip(series, got, strict=True):
        assert p.tolist() == pytest.approx(SE.changepoint_probability(x), abs=1e-9)
    assert SE.changepoint_probabilities([]) == []


@pytest.mark.parametrize("short", [5, 200])
def test_panel_calls_no_python_for_each_series(spark, monkeypatch, short):
    monkeypatch.setattr(SE, "SHORT", short)
    rows = [(k, t, None if (k + t) % 7 == 0 else float("nan") if (k, t) == (9, 2) else float((k * 31 + t * t * 17) % 23)) for k in range(14) for t in range(k)]
    df = spark.createDataFrame(rows, "k long, t long, x double")
    out = SE.panel(df, ["k"], "t", "x", least=4)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    want = {}
    for key in {r[0] for r in rows}:
        own = [(t, x) for k, t, x in rows if k == key and x is not None and not math.isnan(x)]
        if len(own) >= 4:
            n = 0
            flags, p = SE.cusum([x for _, x in own], 0.5, 4.0), SE.changepoint_probability([x for _, x in own])
            for i, (t, _) in enumerate(own):
                n = 0 if i and p[i] > 0.5 else n + 1
                want[key, t] = (pytest.approx(p[i], abs=1e-9), flags[i], n)
    assert {(r.k, r.t): (r.p_change, r.cusum_flag, r.since_change) for r in out.collect()} == want and want
