"""Flags without change probabilities are those of the full panel."""

from pitpanel.operators import series as SE


def test_cusum_panel_equals_panel(spark):
    rows = [(k, t, None if (k + t) % 7 == 0 else float("nan") if (k, t) == (3, 2) else float((k * 31 + t * t * 17) % 23)) for k in range(12) for t in range(k)]
    df = spark.createDataFrame(rows, "k long, t long, x double")
    want = SE.panel(df, ["k"], "t", "x", h=1.0, least=3).select("k", "t", "cusum_flag")
    got = SE.cusum_panel(df, ["k"], "t", "x", h=1.0, least=3)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
