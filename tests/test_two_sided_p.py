"""p of Student's t against its closed forms; no expression is interpreted 800 times a row."""

import math

import pytest

from conftest import SF
from pitpanel.operators import series as SE
from pitpanel.plans import registry


def test_two_sided_p(spark):
    rows = [(t, d) for t in (-30.0, -2.0, 0.0, 0.5, 3.0) for d in (1.0, 2.0)] + [(None, 3.0), (1.0, None)]
    df = spark.createDataFrame(rows, "t double, d double")
    for r in df.select("t", "d", SE.two_sided_p(df.t, df.d).alias("p")).collect():
        if r.t is None or r.d is None:
            assert r.p is None or math.isnan(r.p)
        elif r.d == 1:
            assert r.p == pytest.approx(1 - 2 / math.pi * math.atan(abs(r.t)), abs=1e-5)
        else:
            assert r.p == pytest.approx(1 - abs(r.t) / math.sqrt(2 + r.t * r.t), abs=1e-5)


def test_query_interprets_no_sums(spark):
    plan = registry.collect()[0]["two_window_test"](spark, SF)._jdf.queryExecution().toString()
    assert "aggregate(sequence" not in plan and "ArrowEvalPython" in plan
