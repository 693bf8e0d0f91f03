"""Mixtures of all groups at once against a plain fit of each group."""

from __future__ import annotations

import random

import numpy as np

from pitpanel.operators import mixtures as M
from pitpanel.sources.tables import save

SCHEMA = "g string, id long, a double, b double, cv double"


def rows_of(rng):
    out = []
    for g, n, centres in (("p", 90, [(0, 0), (6, 1), (3, 9)]), ("q", 40, [(1, 1), (-5, 4)]), ("few", 7, [(0, 0)]), ("one", 1, [(0, 0)]), ("flat", 12, None)):
        for i in range(n):
            c = rng.choice(centres) if centres else None
            a, b = (2.0, float(i % 2)) if c is None else (rng.gauss(c[0], 1), rng.gauss(c[1], 0.6))
            out.append((g, i, a, b, abs(b) / 10))
    return [*out, ("p", 500, None, 1.0, 1.0)]


def plain(own, k, per, rounds):
    """id -> cluster of one group after every round, by expectation and maximisation from bands of the first dimension."""
    x = np.array([r[2:4] for r in own])
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    n, kk = len(own), max(1, min(k, len(own) // per))
    order = sorted(range(n), key=lambda i: (z[i, 0], own[i][1]))
    r = np.zeros((n, kk))
    for p, i in enumerate(order):
        r[i, p * kk // n] = 1
    for _ in range(rounds + 1):
        w = r.sum(axis=0)
        dens = np.full((n, kk), -np.inf)
        for j in range(kk):
            m = r[:, j] @ z / w[j]
            cov = (z * r[:, j, None]).T @ z / w[j] - np.outer(m, m) + M.FLOOR * np.eye(2)
            q = z - m
            dens[:, j] = np.log(w[j] / n) - np.log(2 * np.pi) - np.linalg.slogdet(cov)[1] / 2 - np.einsum("ni,ij,nj->n", q, np.linalg.inv(cov), q) / 2
        top = dens.max(axis=1, keepdims=True)
        r = np.exp(dens - top - np.log(np.exp(dens - top).sum(axis=1, keepdims=True)))
        yield {own[i][1]: int(dens[i].argmax()) for i in range(n)}


def test_cluster(spark):
    rows = rows_of(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for rounds in (0, 3):
        got = {(r.g, r.id): r.cluster for r in M.cluster(df, "g", "id", ["a", "b"], save, k=3, rounds=rounds, tolerance=-np.inf).collect()}
        assert len(got) == len(rows) and got["p", 500] is None
        for g in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == g and r[2] is not None]
            want = list(plain(own, 3, 5, rounds))[rounds]
            same = sum(got[g, i] == c for i, c in want.items())
            assert same == len(want), (rounds, g)
    fitted = M.cluster(df, "g", "id", ["a", "b"], save, k=3, rounds=6)
    p = [r for r in fitted.where("g = 'p' and a is not null").collect()]
    for lo, hi in ((-9, 3), (3, 20)):  # the planted clusters apart
        assert len({r.cluster for r in p if lo < r.a < hi and r.b < 4.5}) <= 2
    assert {r.cluster for r in p if r.b > 6.5} == {next(r.cluster for r in p if r.b > 6.5)}


def test_labelled(spark):
    rows = [("p", 1, 5.0, 0.0, 0.1, 0), ("p", 2, 9.0, 0.0, 0.9, 1), ("p", 3, 1.0, 0.0, 0.4, 2), ("q", 4, 1.0, 0.0, 0.4, 0), ("q", 5, 1.0, 0.0, 0.4, None)]
    got = M.labelled(spark.createDataFrame(rows, SCHEMA + ", cluster int"), "g", "a", "cv").collect()
    assert {r.id: r.archetype for r in got} == {1: "p-tier2-stable", 2: "p-tier1-volatile", 3: "p-tier3-stable", 4: "q-tier1-stable", 5: None}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.labelled(M.cluster(none, "g", "id", ["a", "b"], save), "g", "a", "cv").collect() == []
