"""Shares handed on under a cap, and the covariance spectrum, against plain Python and numpy."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.operators.shares import hand_on
from pitpanel.operators.spectrum import covariance, effective_rank, spectrum


def poured(shares, gone, cap):
    """Bit by bit: what is freed is spread in proportion, what a cap refuses again, until nothing moves."""
    x = {m: 0.0 if m in gone else s for m, s in shares.items()}
    left = sum(s for m, s in shares.items() if m in gone)
    for _ in range(10_000):
        open_ = {m for m in x if m not in gone and 0 < x[m] < cap - 1e-13}
        base = sum(shares[m] for m in open_)
        if left < 1e-13 or not base:
            break
        rest = 0.0
        for m in open_:
            new = x[m] + left * shares[m] / base
            rest += max(0.0, new - cap)
            x[m] = min(cap, new)
        left = rest
    return x


def test_hand_on(spark):
    rng = random.Random(12)
    rows = []
    for g in range(60):
        raw = [rng.choice([0.0, 1.0, 1.0, rng.random() * 5]) for _ in range(rng.randrange(1, 9))]
        total = sum(raw) or 1.0
        rows += [(g, m, None if v == 0 and rng.random() < 0.5 else v / total, rng.random() < 0.35) for m, v in enumerate(raw)]
    df = spark.createDataFrame(rows, "g long, m long, s double, out boolean")
    for cap in (0.3, 0.6, 2.0):
        got = {(r.g, r.m): r for r in hand_on(df, ["g"], "m", "s", F.col("out"), cap).collect()}
        by = collections.defaultdict(list)
        for r in rows:
            by[r[0]].append(r)
        for g, own in by.items():
            want = poured({m: s or 0.0 for _, m, s, _ in own}, {m for _, m, _, o in own if o}, cap)
            assert {m: got[g, m].adjusted for m in want} == pytest.approx(want, abs=1e-9)
            capped = [x for x in (got[g, m] for m in want) if x.capped]
            assert all(x.adjusted >= cap - 1e-9 for x in capped)
            freed = sum(s or 0 for _, _, s, o in own if o)
            room = [m for m in want if 0 < want[m] < cap - 1e-9]
            if room:  # where caps allow, nothing is lost
                assert sum(want.values()) == pytest.approx(sum(s or 0 for _, _, s, _ in own)), (g, freed)


def test_hand_on_odd(spark):
    df = spark.createDataFrame([(1, 1, 0.5, True), (1, 2, 0.5, None), (2, 1, 1.0, True), (3, 1, 0.9, False), (3, 2, 0.1, False)], "g long, m long, s double, out boolean")
    got = {(r.g, r.m): (round(r.adjusted, 9), r.capped) for r in hand_on(df, ["g"], "m", "s", F.col("out"), 0.6).collect()}
    assert got == {(1, 1): (0.0, False), (1, 2): (0.6, True), (2, 1): (0.0, False), (3, 1): (0.9, True), (3, 2): (0.1, False)}
    assert hand_on(df.limit(0), ["g"], "m", "s", F.col("out"), 0.6).collect() == []


def test_effective_rank(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 12)) + rng.normal(size=(400, 12)) * 0.3
    x[:, 7] = 2.0  # without spread
    rows = [[float(v) for v in r] for r in x] + [[None, *[1.0] * 11]]
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    cov = np.cov(x, rowvar=False)
    assert np.allclose(covariance(df, names), cov, atol=1e-9)
    values = np.sort(np.maximum(np.linalg.eigvalsh(cov), 0))[::-1]
    shares = values / values.sum()
    some = shares[shares > 1e-15]
    r = effective_rank(df, names).first()
    assert r.participation == pytest.approx(values.sum() ** 2 / (values**2).sum())
    assert r.entropy_rank == pytest.approx(np.exp(-(some * np.log(some)).sum()))
    assert r.shares == pytest.approx(list(shares[:5])) and r.top_share == pytest.approx(shares[:5].sum())
    assert sum(r.leading) >= 0 and np.allclose(cov @ r.leading, values[0] * np.array(r.leading), atol=1e-6)
    with pytest.raises(ValueError):
        spectrum(cov, correlation=True)
    assert spectrum(np.eye(4))["participation"] == pytest.approx(4) == spectrum(np.eye(4) * 3, correlation=True)["entropy_rank"]
    with pytest.raises(ValueError):
        effective_rank(df.limit(1), names)
