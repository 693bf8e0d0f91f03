"""Subgroup discovery: a level-wise beam over conjunctions of attribute = value by weighted relative accuracy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def discover(
    df: DataFrame,
    attributes: Sequence[str],
    target: str,
    save: Callable[[DataFrame], DataFrame],
    *,
    beam: int = 24,
    depth: int = 3,
    least: int = 20,
    least_share: float = 0.001,
    keep: int = 25,
) -> DataFrame:
    """(rank, depth, clauses array, support, positive_rows, positive_rate, base_rate, lift, coverage, wracc), `keep` rows at most.

    Per level every rule of the beam is widened by every value of every attribute that it has none of; a conjunction stays
    if it has max(least, least_share of all rows) rows and a higher rate of target than all rows, and the `beam` best by
    wracc = support / rows * (rate - base rate), then lift, then clauses, go on. The best of all levels are returned.
    Rows with a null target are left out; a null value satisfies no clause; without positives there is no result.

    Equal rows are counted first, so a level reads cells of attribute values, not rows, and is one aggregate over the cells
    that each rule of the beam holds. Only the beam comes to the driver. A conjunction of h positives cannot beat h / rows *
    (1 - base rate), nor can any that widens it: a search whose beam is below the `keep`-th best by this bound ends, and
    on the last level rules below it are not widened.
    """
    spark = df.sparkSession
    named = df.select(*[F.col(c).cast("string").alias(f"_a{i}") for i, c in enumerate(attributes)], F.col(target).cast("int").alias("_hit"))
    cells = save(named.where("_hit is not null").groupBy(*[f"_a{i}" for i in range(len(attributes))]).agg(F.count("*").alias("_n"), F.sum("_hit").cast("long").alias("_h")))
    rows, positives = cells.agg(F.sum("_n"), F.sum("_h")).first()
    kind = "rank int, depth int, clauses array<string>, support long, positive_rows long, positive_rate double, base_rate double, lift double, coverage double, wracc double"
    if not positives:
        return spark.createDataFrame([], kind)
    low = max(least, -(-rows * least_share // 1))
    gain = lambda s, h: h * rows - s * positives  # wracc in whole numbers: * rows * rows
    clause = lambda i: F.concat(F.lit(f"{attributes[i]}="), F.col(f"_a{i}"))
    frontier: list[tuple] = [()]  # rules as (attribute index, value) pairs
    found: list[tuple] = []
    for level in range(1, depth + 1):
        wider = []
        for rule in frontier:
            has = {i for i, _ in rule}
            holds = F.lit(True)
            for i, v in rule:
                holds = holds & F.col(f"_a{i}").eqNullSafe(F.lit(v))
            own = [F.concat(F.lit(f"{attributes[i]}="), F.lit(v)) for i, v in rule]
            each = [F.when(F.col(f"_a{i}").isNotNull(), F.array_sort(F.array(*own, clause(i)))) for i in range(len(attributes)) if i not in has]
            if each:
                wider.append(F.when(holds, F.array_compact(F.array(*each))).otherwise(F.array().cast("array<array<string>>")))
        if not wider:
            break
        # a cell that two rules of the beam widen to the same conjunction counts once
        met = cells.select("_n", "_h", F.explode(F.array_distinct(F.flatten(F.array(*wider)))).alias("clauses"))
        sums = met.groupBy("clauses").agg(F.sum("_n").alias("s"), F.sum("_h").alias("h")).where((F.col("s") >= low) & (F.col("h") * rows > F.col("s") * positives))
        best = sums.orderBy(F.desc(F.col("h") * rows - F.col("s") * positives), F.desc(F.col("h") / F.col("s")), F.array_join("clauses", "\x01")).limit(beam)
        level_rules = [(gain(x.s, x.h), x.h / x.s, tuple(x.clauses), level, x.s, x.h) for x in best.collect()]
        found = sorted(found + level_rules, key=lambda x: (-x[0], -x[1], x[2]))[:keep]
        bar = found[-1][0] if len(found) == keep else 0
        going = [x for x in level_rules if x[5] * (rows - positives) >= bar]  # the bound, in the same whole numbers
        if not going:
            break
        if level + 1 == depth:
            level_rules = going
        by_name = {c: i for i, c in enumerate(attributes)}
        frontier = [tuple((by_name[c.split("=", 1)[0]], c.split("=", 1)[1]) for c in x[2]) for x in level_rules]
    base = positives / rows
    out = [
        (k, lv, list(c), s, h, h / s, base, h / s / base, h / positives, s / rows * (h / s - base))
        for k, (_, _, c, lv, s, h) in enumerate(found, 1)
    ]
    return spark.createDataFrame(out, kind)
