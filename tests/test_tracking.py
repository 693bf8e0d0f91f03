"""Traits of moving subjects and risk control against plain Python."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import evaluate as V
from pitpanel.operators import tracking as TR

COLS = "game long, play long, frame int, subject long, week int, role string, way string, x double, y double, speed double, accel double, dir double"


def made(rng):
    rows = []
    for game, play in ((g, p) for g in range(3) for p in range(6)):
        way, frames = rng.choice(["left", "right", None]), rng.randrange(1, 6)
        who = rng.sample(range(20), 8)
        for k, subject in enumerate(who):
            role = ("target", "mover", "mover", "marker", "marker", "marker", "other", "target")[k]
            for f in range(frames):
                num = lambda top: round(rng.random() * top, 3)
                rows.append((game, play, f, subject, game + 1, role, way, num(120), num(53.3), num(10), num(5), num(360)))
    return rows


def test_traits(spark):
    rows = made(random.Random(4))
    df = spark.createDataFrame(rows + [(9, 9, 0, None, 1, "mover", None, 1.0, 1.0, 1.0, 1.0, 1.0)], COLS).repartition(5)
    turned = TR.oriented(df, F.col("way") == "left", 120, 53.3, angles=["dir"])
    kinds = dict(role="role", movers=["mover", "target"], target="target", marker="marker")
    got = {r.subject: r for r in TR.traits(turned, ["game", "play"], "subject", "frame", "week", **kinds).collect()}
    turn = lambda r: r if r[6] != "left" else (*r[:7], 120 - r[7], 53.3 - r[8], *r[9:11], (r[11] + 180) % 360)
    rows = [turn(r) for r in rows]
    assert {(r[0], r[1], r[2], r[3]): round(r[11], 6) for r in rows} == {(r.game, r.play, r.frame, r.subject): round(r.dir, 6) for r in turned.where("subject is not null").collect()}
    plays = collections.defaultdict(list)
    for r in rows:
        plays[r[:2]].append(r)
    depth, apart = collections.defaultdict(list), collections.defaultdict(list)
    for own in plays.values():
        last = max(r[2] for r in own)
        for s in {r[3] for r in own if r[5] in ("mover", "target")}:
            path = sorted(r for r in own if r[3] == s)
            depth[s].append(path[-1][7] - path[0][7])
        for t in (r for r in own if r[5] == "target" and r[2] == last):
            apart[t[3]].append(min(math.hypot(t[7] - m[7], t[8] - m[8]) for m in own if m[5] == "marker" and m[2] == last))
    assert set(got) == {r[3] for r in rows}
    for s, g in got.items():
        own = [r for r in rows if r[3] == s]
        run, mark = [r for r in own if r[5] in ("mover", "target")], [r for r in own if r[5] == "marker"]
        assert (g.frames, g.periods, g.last_period) == (len(own), len({r[4] for r in own}), max(r[4] for r in own))
        assert (g.mover_plays, g.marker_plays, g.target_plays) == (len({r[:2] for r in run}), len({r[:2] for r in mark}), len(apart[s]))
        assert (g.speed_n, g.marker_speed_n) == (len(run), len(mark))
        for have, values, stat in (
            (g.speed_mean, [r[9] for r in run], np.mean), (g.speed_p90, [r[9] for r in run], None), (g.accel_p90, [r[10] for r in run], None),
            (g.marker_speed_p90, [r[9] for r in mark], None), (g.depth_mean, depth[s], np.mean), (g.depth_p90, depth[s], None), (g.separation_mean, apart[s], np.mean),
        ):
            want = None if not values else np.mean(values) if stat else np.quantile(values, 0.9)
            assert have == (want if want is None else pytest.approx(want, abs=1e-9))
    assert TR.traits(turned.limit(0), ["game", "play"], "subject", "frame", "week", **kinds).collect() == []


def test_risk_control(spark):
    def run(losses):
        rows = [(float(k), float(x)) for k, xs in losses.items() for x in xs]
        return V.risk_control(spark.createDataFrame(rows, "knob double, loss double"), "knob", "loss", 0.3).collect()

    (one,) = run({1: [1] * 10, 2: [1, 1] + [0] * 8, 3: [0] * 10})
    assert (one.knob, one.risk, one.satisfied) == (2.0, 0.2, True) and one.bound == pytest.approx(3 / 11)
    (none,) = run({1: [1] * 10, 2: [1] * 10})
    assert (none.knob, none.satisfied) == (2.0, False)
    assert run({}) == []
    with pytest.raises(Exception, match="rises"):
        run({1: [0, 0], 2: [1, 0]})
    with pytest.raises(Exception, match="range"):
        run({1: [2, 0]})
