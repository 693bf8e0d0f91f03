"""Quotas of class and source against the allocation made row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pitpanel.operators.quotas import allocate, largest_remainder, rotation
from pitpanel.sources.tables import save

CLASSES = {"core": 0.5, "wild": 0.2, "mixed": 0.2, "rare": 0.1}
SOURCES = ["s1", "s2", "s3"]


def one_by_one(rows, budget):
    """ids in the order in which they are taken. rows: (id, class, source, score), the higher score first."""
    class_target, source_target = largest_remainder(budget, list(CLASSES), CLASSES), largest_remainder(budget, SOURCES)
    order = lambda r: (list(CLASSES).index(r[1]), -r[3], r[0])
    left, used, out = sorted(rows, key=order), dict.fromkeys(SOURCES, 0), []

    def take(r):
        left.remove(r)
        used[r[2]] += 1
        out.append(r[0])

    for i, c in enumerate(CLASSES):
        cursor = i % len(SOURCES)
        for _ in range(class_target[c]):
            for step in range(len(SOURCES)):
                s = SOURCES[(cursor + step) % len(SOURCES)]
                mine = [r for r in left if r[1] == c and r[2] == s]
                if used[s] < source_target[s] and mine:
                    take(mine[0])
                    cursor = (cursor + step + 1) % len(SOURCES)
                    break
            else:
                break
    for s in SOURCES:
        for r in [r for r in left if r[2] == s][: source_target[s] - used[s]]:
            take(r)
    for r in left[: budget - len(out)]:
        take(r)
    return out


def test_allocate(spark):
    rng = random.Random(31)
    for weights, budget in (((4, 4, 4), 30), ((9, 1, 1), 45), ((1, 1, 1), 60), ((20, 1, 0), 50), ((1, 2, 3), 1)):
        rows = [(i, rng.choices(list(CLASSES), (3, 3, 1, 0.2))[0], rng.choices(SOURCES, weights)[0], rng.randrange(20)) for i in range(60)]
        df = spark.createDataFrame(rows, "id long, cls string, src string, score long").repartition(3)
        chosen, receipt = allocate(df, budget, "cls", "src", [F.desc("score"), "id"], CLASSES, SOURCES, save)
        got = {r.allocation_rank: r.id for r in chosen.collect()}
        want = one_by_one(rows, budget)
        assert [got[k] for k in sorted(got)] == want and sorted(got) == list(range(1, budget + 1))
        told = {(r.kind, r.label): (r.target, r.available, r.selected, r.shortfall) for r in receipt.collect()}
        for c, t in largest_remainder(budget, list(CLASSES), CLASSES).items():
            n = sum(rows[i][1] == c for i in want)
            assert told["class", c] == (t, sum(r[1] == c for r in rows), n, max(0, t - n))
        assert sum(told["source", s][2] for s in SOURCES) == budget


def test_quotas_of_counts():
    assert largest_remainder(10, ["a", "b", "c"]) == {"a": 4, "b": 3, "c": 3}
    assert largest_remainder(7, ["a", "b"], {"a": 0.9, "b": 0.1}) == {"a": 6, "b": 1}
    rng = random.Random(1)
    for _ in range(500):
        order = [f"s{i}" for i in range(rng.randrange(1, 6))]
        room, target = {s: rng.randrange(-1, 9) for s in order}, rng.randrange(30)
        want, left, i = dict.fromkeys(order, 0), min(target, sum(max(0, x) for x in room.values())), 0
        while left:
            s = order[i % len(order)]
            if want[s] < room[s]:
                want[s], left = want[s] + 1, left - 1
            i += 1
        assert rotation(target, room, order) == want
    for bad in (lambda: largest_remainder(1, []), lambda: largest_remainder(1, ["a", "a"]), lambda: largest_remainder(1, ["a"], {"a": 0})):
        with pytest.raises(ValueError):
            bad()


def test_what_cannot_be_allocated(spark):
    df = spark.createDataFrame([(1, "core", "s1", 1), (2, "other", "s1", 1)], "id long, cls string, src string, score long")
    for rows, budget in ((df, 1), (df.where("id = 1"), 2), (df.where("id = 1"), 0)):
        with pytest.raises(ValueError):
            allocate(rows, budget, "cls", "src", ["id"], CLASSES, SOURCES, save)
