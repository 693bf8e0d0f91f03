"""The walk-forward ridge against numpy, row by row."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pitpanel.operators.regress import walk_forward_ridge

SCHEMA = "grp string, epoch long, id long, a double, b double, c double, d double, y double"


def panel(rng, n=400):
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(5, 3)
        y = None if rng.random() < 0.03 else 2 * a - b + rng.gauss(0, 0.5)
        rows.append((rng.choice("pqr"), rng.choice([2001, 2002, 2004, 2005, 2006, 2007]), i, a, None if rng.random() < 0.2 else b, 7.0, None, y))
    return rows


def plain(rows, alpha, min_rows, min_epochs):
    """id -> (predicted, residual, z): a model for each group and epoch, fitted on the rows before it."""
    rows = [r for r in rows if r[7] is not None]
    epochs, out = sorted({r[1] for r in rows})[min_epochs:], {}
    for e in epochs:
        for g in {r[0] for r in rows}:
            past, now = [r for r in rows if r[0] == g and r[1] < e], [r for r in rows if r[0] == g and r[1] == e]
            if len(past) < min_rows or not now:
                continue
            x = np.array([r[3:7] for r in past], dtype=float)
            mean = np.nan_to_num(np.nanmean(np.where(np.isnan(x).all(0), 0, x), axis=0))
            fill = lambda m: np.where(np.isnan(m), mean, m)  # noqa: B023, E731
            dev = fill(x).std(axis=0)
            dev[dev == 0] = 1
            z, y = (fill(x) - mean) / dev, np.array([r[7] for r in past])
            w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean()))
            fit = y.mean() + (fill(np.array([r[3:7] for r in now], dtype=float)) - mean) / dev @ w
            res = np.array([r[7] for r in now]) - fit
            sd = res.std()
            for r, p, q in zip(now, fit, res, strict=True):
                out[r[2]] = (p, q, q / sd if sd > 0 else 0)
    return out


@pytest.mark.parametrize(("alpha", "min_rows", "min_epochs"), [(5.0, 20, 3), (0.5, 60, 1)])
def test_walk_forward(spark, alpha, min_rows, min_epochs):
    rows = panel(random.Random(4))
    got = walk_forward_ridge(spark.createDataFrame(rows, SCHEMA), ["grp"], "epoch", ["a", "b", "c", "d"], "y", alpha=alpha, min_rows=min_rows, min_epochs=min_epochs).collect()
    want = plain(rows, alpha, min_rows, min_epochs)
    assert {r.id for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        assert np.allclose((r.predicted, r.residual, r.residual_z), want[r.id], rtol=1e-7, atol=1e-7)
        assert r.watchlist == (r.residual_z <= -1.5)
    assert any(r.watchlist for r in got)


def test_the_future_has_no_say(spark):
    """Changing or removing rows of an epoch and later ones changes no earlier row's residual."""
    rows = panel(random.Random(5))
    changed = [r if r[1] < 2005 else (*r[:3], 9.0, 1.0, -4.0, 2.0, 1000.0) for r in rows]
    scored = []
    for table in (rows, changed, [r for r in rows if r[1] < 2005]):
        out = walk_forward_ridge(spark.createDataFrame(table, SCHEMA), ["grp"], "epoch", ["a", "b", "c"], "y", min_epochs=1)
        scored.append({r.id: round(r.residual, 9) for r in out.where("epoch < 2005").collect()})
    assert scored[0] and scored[0] == scored[1] == scored[2]


def test_odd_tables(spark):
    one = lambda rows, **k: walk_forward_ridge(spark.createDataFrame(rows, SCHEMA), ["grp"], "epoch", ["a"], "y", **k).collect()
    assert one([]) == []
    flat = [("p", e, i, 1.0, 1.0, 1.0, 1.0, 3.0) for e in (1, 2) for i in range(25)]
    assert [(r.predicted, r.residual_z) for r in one(flat, min_epochs=1)] == [(3.0, 0.0)] * 25  # no spread anywhere
    assert one(flat, min_epochs=1, min_rows=26) == []
    again = one([*flat, *flat], min_epochs=1)
    assert len(again) == 50  # repeated rows are rows
