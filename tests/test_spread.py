"""Partitions follow the rows: four times the rows, no more of them in a task."""

import os

import pytest

from conftest import SF, TABLES
from pitpanel.plans import bindings, registry


@pytest.mark.parametrize("name", ["agg_spearman", "agg_share_over_expected", "basket_features", "set_overlap_vs_null", "pair_lift_graph", "tracking_traits"])
def test_partitions_follow_rows(spark, tmp_path, monkeypatch, name):
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    each = rows // 40
    monkeypatch.setattr(bindings.spread, "__kwdefaults__", {"each": each})
    plan = registry.collect()[0][name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert f", {-(-rows // each)}), REPARTITION_BY_NUM" in plan


def test_never_fewer_partitions_than_the_session(spark):
    assert bindings.spread(spark.range(10), 10, "id").rdd.getNumPartitions() == 4
