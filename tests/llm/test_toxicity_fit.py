"""The rows that the toxicity models are fitted on are found without moving all texts."""

import pytest

toxicity = pytest.importorskip("pitpanel.llm.toxicity")


def test_fitted_rows_leave_texts_in_place(spark):
    df = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(200)], "doc_id long, text string, toxic int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = toxicity.fitted(df, 50)
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
        assert len({r.doc_id for r in out.collect()}) == out.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
