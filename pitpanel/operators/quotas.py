"""A fixed budget of rows by quotas of class and source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators import ranks as K


def largest_remainder(budget: int, labels: Sequence[str], weights: Mapping[str, float] | None = None) -> dict[str, int]:
    """Whole quotas that sum to budget: the floors of the exact ones, and one more for the largest fractions, earlier labels first."""
    if budget < 0 or not labels or len(set(labels)) != len(labels):
        raise ValueError("a budget of 0 or more, and labels that differ")
    w = {x: 1.0 / len(labels) if weights is None else float(weights[x]) for x in labels}
    total = sum(w.values())
    if total <= 0 or min(w.values()) < 0:
        raise ValueError("weights are 0 or more, and not all 0")
    exact = {x: budget * w[x] / total for x in labels}
    out = {x: int(exact[x]) for x in labels}
    for x in sorted(labels, key=lambda x: out[x] - exact[x])[: budget - sum(out.values())]:
        out[x] += 1
    return out


def rotation(target: int, room: Mapping[str, int], order: Sequence[str]) -> dict[str, int]:
    """How many each of `order` gives if they give one each in turn, those without room being passed over, up to target."""
    out = dict.fromkeys(order, 0)
    left = min(target, sum(max(0, room[x]) for x in order))
    while left:
        open_ = [x for x in order if out[x] < room[x]]
        turns = min(min(room[x] - out[x] for x in open_), left // len(open_))  # whole turns that all of them can give
        for i, x in enumerate(open_):
            add = turns if turns else int(i < left)
            out[x] += add
        left -= turns * len(open_) if turns else left
    return out


def allocate(
    df: DataFrame,
    budget: int,
    cls: str,
    source: str,
    order: Sequence[str],
    classes: Mapping[str, float],
    sources: Sequence[str],
    save: K.Save,
) -> tuple[DataFrame, DataFrame]:
    """(df's chosen rows with allocation_rank, receipt): exactly `budget` rows.

    Classes have quotas by their weights, sources equal ones, both by largest remainder. Class by class, in order, the sources
    take turns (each class beginning one source further) and give the best rows by `order`, a total order, while source and class have some.
    What a class cannot fill is filled from every source's own quota, better classes first; what a source cannot fill, from
    all that is left, by class and order. receipt: (kind, label, target, available, selected, shortfall).
    Rows of other classes or sources, or without one, are an error, as is a budget over the number of rows.

    Only the counts by class and source go to the driver: how many of each are taken follows from them. The rows are
    numbered within class and source by ranges, so no task sorts a whole class.
    """
    placed = save(K.numbered(df, [cls, source], list(order), save, "_place").drop("_place_all"))
    have = {(r[0], r[1]): r[2] for r in placed.groupBy(cls, source).agg(F.count("*")).collect()}  # classes x sources
    if {c for c, _ in have} - set(classes) or {s for _, s in have} - set(sources):
        raise ValueError("a row has a class or source that is not listed")
    if budget <= 0 or sum(have.values()) < budget:
        raise ValueError(f"{sum(have.values())} rows for a budget of {budget}")
    class_target = largest_remainder(budget, list(classes), classes)
    source_target = largest_remainder(budget, list(sources))
    used, taken, ranks, at = dict.fromkeys(sources, 0), {}, [], 0
    turns = {}  # of class and source: (first rank of the class, the source's place in the turn)
    for i, c in enumerate(classes):
        turn = [sources[(i + j) % len(sources)] for j in range(len(sources))]
        give = rotation(class_target[c], {s: min(have.get((c, s), 0), source_target[s] - used[s]) for s in sources}, turn)
        for j, s in enumerate(turn):
            taken[c, s], turns[c, s] = give[s], (at, j)
            used[s] += give[s]
        ranks.append((c, [give[s] for s in turn]))
        at += sum(give.values())
    primary = at
    filled, second = {}, {}  # rows that a source's quota takes of a class beside those, and the rank that they begin at
    for s in sources:
        need = source_target[s] - used[s]
        for c in classes:
            n = min(need, have.get((c, s), 0) - taken[c, s])
            filled[c, s], second[c, s] = n, at
            need, at, used[s] = need - n, at + n, used[s] + n
    last = {}  # rows that are taken of a class of what is left, and the rank that they begin at
    for c in classes:
        n = min(budget - at, sum(have.get((c, s), 0) - taken[c, s] - filled[c, s] for s in sources))
        last[c] = (n, at)
        at += n
    cells = [(c, s, taken[c, s], turns[c, s][0], turns[c, s][1], filled[c, s], second[c, s], last[c][0], last[c][1], dict(ranks)[c]) for c in classes for s in sources]
    kinds = f"`{cls}` string, `{source}` string, _n1 int, _r1 int, _j int, _n2 int, _r2 int, _n3 int, _r3 int, _give array<int>"
    x = placed.join(F.broadcast(df.sparkSession.createDataFrame(cells, kinds)), [cls, source])
    # in a class's turns, before the p-th row of the j-th source: p - 1 (or all they give) of every one, and the p-th of those before it
    p, j = F.col("_place"), F.col("_j")
    earlier = F.aggregate(F.transform("_give", lambda g, i: F.least(g, p - F.when(i < j, 0).otherwise(1)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    one = x.where("_place <= _n1").withColumn("allocation_rank", F.col("_r1") + earlier + 1)
    two = x.where("_place > _n1 and _place <= _n1 + _n2").withColumn("allocation_rank", F.col("_r2") + F.col("_place") - F.col("_n1"))
    out = one.unionByName(two)
    if primary + sum(filled.values()) < budget:
        rest = K.numbered(x.where("_place > _n1 + _n2 and _n3 > 0"), [cls], list(order), save, "_q").where("_q <= _n3")
        out = out.unionByName(rest.withColumn("allocation_rank", F.col("_r3") + F.col("_q")).drop("_q", "_q_all"))
    chosen = save(out.select(*df.columns, F.col("allocation_rank").cast("int").alias("allocation_rank")))
    got = {(r[0], r[1]): r[2] for r in chosen.groupBy(cls, source).agg(F.count("*")).collect()}
    table = [("class", c, class_target[c], sum(n for (k, _), n in have.items() if k == c), sum(n for (k, _), n in got.items() if k == c)) for c in classes]
    table += [("source", s, source_target[s], sum(n for (_, k), n in have.items() if k == s), sum(n for (_, k), n in got.items() if k == s)) for s in sources]
    receipt = df.sparkSession.createDataFrame([(*r, max(0, r[2] - r[4])) for r in table], "kind string, label string, target int, available long, selected long, shortfall long")
    return chosen, receipt
