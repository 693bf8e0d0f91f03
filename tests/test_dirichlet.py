"""The concentration against a plain likelihood."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pitpanel.operators.dirichlet import fit_concentration, log_gamma


def plain_loss(rows, share, kappa):
    out = 0.0
    for r in rows:
        out -= math.lgamma(kappa) - math.lgamma(kappa + sum(r)) + sum(math.lgamma(kappa * p + x) - math.lgamma(kappa * p) for p, x in zip(share, r, strict=True))
    return out


def test_log_gamma():
    x = np.concatenate([np.geomspace(1e-9, 1e9, 400), np.arange(1, 30)])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_concentration(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet(np.array([0.5, 0.3, 0.2]) * 20, size=400)
    rows = [[int(v) for v in rng.multinomial(60, q)] for q in p]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] + [(None, None, None, 0)], "a long, b long, c long, m long")
    got = fit_concentration(df, ["a", "b", "c"]).first()
    share = np.array(rows).sum(axis=0) / np.sum(rows)
    grid = np.geomspace(5, 80, 3000)
    losses = [plain_loss(rows, share, k) for k in grid]
    assert got.nll == pytest.approx(plain_loss(rows, share, got.concentration)) and got.nll <= min(losses) + 0.05
    assert got.concentration == pytest.approx(grid[int(np.argmin(losses))], rel=0.1) and 14 < got.concentration < 28
    assert got.nll_multinomial == pytest.approx(-(np.array(rows).sum(axis=0) * np.log(share)).sum())
    assert got.gain == pytest.approx(got.nll_multinomial - got.nll) and got.gain > 100  # the groups do differ
    alike = [[int(v) for v in rng.multinomial(60, [0.5, 0.3, 0.2])] for _ in range(300)]
    same = fit_concentration(spark.createDataFrame(alike, "a long, b long, c long"), ["a", "b", "c"]).first()
    assert same.gain < 5 and same.concentration > 100


def test_no_counts(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert fit_concentration(none, ["a", "b"]).collect() == []
    assert fit_concentration(spark.createDataFrame([(0, 0)], "a long, b long"), ["a", "b"]).collect() == []
