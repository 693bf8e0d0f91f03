"""Leakage and data-quality gates. Each returns its violations as a DataFrame; `require_none` raises if there are any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.operators.windows import frame


class LeakageError(AssertionError):
    """A gate found violations."""


def require_none(violations: DataFrame, gate: str, shown: int = 5) -> None:
    rows = violations.limit(shown).collect()
    if rows:
        raise LeakageError(f"{gate}: {[r.asDict() for r in rows]}")


def no_leakage(
    built: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str], feature: str, value: str, n: int | None,
    *, statistic: str = "avg", atol: float = 1e-6, parity: bool = True,
) -> DataFrame:
    """Rows whose built feature differs from the statistic of the strictly prior rows of the source, or in being null."""
    agg = {"avg": F.avg, "stddev": F.stddev_samp, "sum": F.sum}[statistic](value)
    expected = source.select(*keys, *order, agg.over(frame(keys, order, n)).alias("_expected"))
    both = built.join(expected, [*keys, *order])
    a, b = F.col(feature), F.col("_expected")
    bad = F.abs(a - b) > atol
    if parity:
        bad = F.coalesce(bad, a.isNull() != b.isNull())
    return both.where(bad).select(*keys, *order, a.alias("built"), b.alias("expected"))


def recompute_match(built: DataFrame, again: DataFrame, keys: Sequence[str], features: Sequence[str], atol: float) -> DataFrame:
    """(keys, feature, built, expected, why) of keys on one side only, nulls on one side only and values apart."""
    a = built.select(*keys, F.lit(True).alias("_a"), *[F.col(f).cast("double").alias(f"a_{f}") for f in features])
    b = again.select(*keys, F.lit(True).alias("_b"), *[F.col(f).cast("double").alias(f"b_{f}") for f in features])
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").alias("built"), F.col(f"b_{f}").alias("expected")) for f in features]
    out = a.join(b, list(keys), "full").select(*keys, "_a", "_b", F.inline(F.array(*rows)))
    why = (
        F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra")
        .when(F.col("built").isNull() != F.col("expected").isNull(), "null")
        .when(F.abs(F.col("built") - F.col("expected")) > atol, "value")
    )
    return out.withColumn("why", why).where("why is not null").drop("_a", "_b")


def first_row_null(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str]) -> DataFrame:
    """First rows of a key that have a value in a prior-only feature."""
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1")
    bad = [F.when(F.col(f).isNotNull(), F.lit(f)) for f in features]
    return first.select(*keys, *order, F.explode(F.array_compact(F.array(*bad))).alias("feature"))


def source_strict_prior(df: DataFrame, target: Column, source: Column) -> DataFrame:
    return df.where(source >= target)


def unreached(eligible: DataFrame, output: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Eligible keys that did not reach the output."""
    return eligible.select(*keys).distinct().join(output.select(*keys), list(keys), "left_anti")


def cutoff_coverage(source: DataFrame, cutoffs: DataFrame, built: DataFrame, period: str) -> DataFrame:
    """Periods with source rows but without a cutoff, or without built rows."""
    count = lambda df, name: df.groupBy(period).agg(F.count("*").alias(name))
    out = count(source, "source_rows").join(count(cutoffs, "cutoffs"), period, "full").join(count(built, "built_rows"), period, "full")
    out = out.na.fill(0, ["source_rows", "cutoffs", "built_rows"])
    return out.where("source_rows > 0 and (cutoffs = 0 or built_rows = 0)")


def rule_suite(rules: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, violations): every rule's DataFrame of violations counted."""
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(k).alias("rule"), "violations") for k, df in rules.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def frame_contract(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) of row rules that must be true, in one pass."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])))


def missingness(df: DataFrame, features: Sequence[str], by: Sequence[str], error: Column) -> DataFrame:
    """Per feature and group: rows, nulls, null rate, and the mean error where null and where present; one pass."""
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f).isNull().alias("gone")) for f in features]
    long = df.select(*by, error.alias("_e"), F.inline(F.array(*rows)))
    return long.groupBy("feature", *by).agg(
        F.count("*").alias("rows"), F.count_if("gone").alias("nulls"), F.avg(F.col("gone").cast("int")).alias("null_rate"),
        F.avg(F.when(F.col("gone"), F.col("_e"))).alias("error_null"), F.avg(F.when(~F.col("gone"), F.col("_e"))).alias("error_present"),
    )
