"""The audit writes a fact once, not once for each feature and rank."""

from conftest import SF
from pitpanel.plans import gates_plans


def test_facts_are_written_once(spark, monkeypatch):
    written = []
    save = gates_plans.save
    monkeypatch.setattr(gates_plans, "save", lambda df: written.append(save(df)) or written[-1])
    assert gates_plans.QUERIES["dq_redundancy_audit"](spark, SF).count() == 2
    assert sum(x.count() for x in written) < 1.5 * spark.read.parquet(f"{SF}/lineitem.parquet").count()
