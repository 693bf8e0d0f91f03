"""The queries of the plan modules and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["windows_plans", "joins_plans", "exprs_plans", "aggs_plans", "gates_plans", "evaluate_plans", "baskets_plans", "graph_plans", "sources_plans", "streaming_plans", "studies_plans", "samples_plans"]

Query = Callable[[SparkSession, str], DataFrame]


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"pitpanel.plans.{name}")
        found |= module.QUERIES
        sql |= module.SQL
    return found, sql
