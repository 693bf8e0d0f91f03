"""Gaussian mixtures of all groups at once: a round is one aggregate of sufficient statistics by group and component."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.operators import ranks as K

FLOOR = 1e-6


def zscored(df: DataFrame, group: str, dims: Sequence[str]) -> DataFrame:
    """df with _z0, _z1, ...: each dimension less its group's mean, over its deviation (over all rows; 1 where there is none)."""
    s = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), *[x for i, c in enumerate(dims) for x in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_d{i}"))])
    out = df.join(s, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    z = {f"_z{i}": (F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_d{i}") > 0, F.col(f"_d{i}")).otherwise(1.0) for i, c in enumerate(dims)}
    return out.withColumns(z).drop(*[f"_{x}{i}" for x in "md" for i in range(len(dims))])


def _statistics(rows: DataFrame, group: str, d: int) -> DataFrame:
    """(group, comp, r, s array, q array, ll): sums over rows of (group, comp, r, _z..., ll)."""
    s = F.array(*[F.sum(F.col("r") * F.col(f"_z{i}")) for i in range(d)])
    q = F.array(*[F.sum(F.col("r") * F.col(f"_z{i}") * F.col(f"_z{j}")) for i in range(d) for j in range(d)])
    return rows.groupBy(group, "comp").agg(F.sum("r").alias("r"), s.alias("s"), q.alias("q"), F.sum("ll").alias("ll"))


def _models(stats: DataFrame, group: str, d: int) -> DataFrame:
    """(group, n, ll, model array of (comp, c, m array, p array)): mean, precision, and the logarithm of weight and normaliser."""
    kind = stats.schema[group].dataType.simpleString()

    def solve(batches):
        for b in batches:
            r = b["r"].to_numpy(float)
            m = np.stack(b["s"].to_list()).astype(float) / r[:, None] if len(b) else np.zeros((0, d))
            q = np.stack(b["q"].to_list()).astype(float).reshape(-1, d, d) / r[:, None, None] if len(b) else np.zeros((0, d, d))
            cov = q - m[:, :, None] * m[:, None, :] + FLOOR * np.eye(d)
            p = np.linalg.inv(cov)
            out = b[[group, "comp", "r", "ll"]].copy()
            out["m"], out["p"] = list(m), list(p.reshape(-1, d * d))
            out["norm"] = -0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1])
            yield out

    found = stats.where("r > 1e-9").mapInPandas(solve, f"`{group}` {kind}, comp int, r double, ll double, m array<double>, p array<double>, norm double")
    by = found.groupBy(group).agg(F.sum("r").alias("n"), F.sum("ll").alias("ll"), F.array_sort(F.collect_list(F.struct("comp", "r", "norm", "m", "p"))).alias("parts"))
    model = F.transform("parts", lambda x: F.struct(x["comp"].alias("comp"), (F.ln(x["r"] / F.col("n")) + x["norm"]).alias("c"), x["m"].alias("m"), x["p"].alias("p")))
    return by.select(F.col(group).alias("_g"), "n", "ll", model.alias("model"))


def _density(d: int) -> Column:
    """The log density of a row in each component, by component."""

    def one(x: Column) -> Column:
        diff = [F.col(f"_z{i}") - x["m"][i] for i in range(d)]
        form = sum((diff[i] * x["p"][i * d + j] * diff[j] for i in range(d) for j in range(d)), F.lit(0.0))
        return F.struct(x["comp"].alias("comp"), (x["c"] - form / 2).alias("l"))

    return F.transform("model", one)


def cluster(df: DataFrame, group: str, member: str, dims: Sequence[str], save: K.Save, *, k: int = 4, per: int = 5, rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """df with cluster (int, from 0; null where a dimension is null): per group a mixture of min(k, rows / per), one at least, Gaussians.

    Dimensions are z-scored within the group. The start is fixed: bands of equal size by the first dimension, then member.
    Rounds end when no group's mean log likelihood grows by `tolerance`, or after `rounds` of them. A row's cluster is the component
    most likely for it, the smaller number on ties; the number of a component is that of its band. members are unique in a group.

    Rows stay where they are: a round joins them with their group's model (k small arrays) and sends sums, combined before the
    shuffle. No group is gathered in a task.
    """
    d, whole = len(dims), F.lit(True)
    for c in dims:
        whole = whole & F.col(c).isNotNull()
    z = zscored(df.where(whole).select(group, member, *dims), group, dims)
    n_comp = F.greatest(F.lit(1), F.least(F.lit(k), F.floor(F.col("_n") / per))).cast("int")
    z = K.numbered(z.withColumn("_k", n_comp), [group], ["_z0", member], save, "_p")
    z = save(z.select(group, member, *[f"_z{i}" for i in range(d)], F.floor((F.col("_p") - 1) * F.col("_k") / F.col("_n")).cast("int").alias("_band")))
    rows = z.withColumns({"comp": F.col("_band"), "r": F.lit(1.0), "ll": F.lit(0.0)})
    before, model = None, None
    for i in range(rounds + 1):
        model = save(_models(_statistics(rows, group, d), group, d))
        if i > 1:
            grown = model.alias("a").join(before.alias("b"), F.col("a._g").eqNullSafe(F.col("b._g"))).where((F.col("a.ll") - F.col("b.ll")) / F.col("a.n") >= tolerance)
            if not grown.limit(1).count():
                break
        before = model
        dense = z.join(model, F.col(group).eqNullSafe(F.col("_g"))).withColumn("l", _density(d))
        top = F.array_max(F.transform("l", lambda x: x["l"]))
        total = F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x["l"] - F.col("top")))
        dense = dense.withColumn("top", top).withColumn("all", F.col("top") + F.ln(total))
        each = F.transform("l", lambda x: F.struct(x["comp"].alias("comp"), F.exp(x["l"] - F.col("all")).alias("r"), F.when(x["comp"] == F.col("l")[0]["comp"], F.col("all")).otherwise(0.0).alias("ll")))
        rows = dense.select(group, *[f"_z{j}" for j in range(d)], F.inline(each))
    best = z.join(model, F.col(group).eqNullSafe(F.col("_g"))).select(F.col(group).alias("_g2"), F.col(member).alias("_m2"), F.array_max(F.transform(_density(d), lambda x: F.struct(x["l"].alias("l"), (-x["comp"]).alias("c"))))["c"].alias("_c"))
    out = df.join(best, F.col(group).eqNullSafe(F.col("_g2")) & (F.col(member) == F.col("_m2")), "left")
    return out.select(*df.columns, (-F.col("_c")).alias("cluster"))


def labelled(clustered: DataFrame, group: str, score: str, spread: str) -> DataFrame:
    """clustered with archetype: '<group>-tier<t>-<stable or volatile>'.

    Within a group tier 1 is the cluster with the highest mean score (ties: the smaller number); volatile is one whose mean
    spread is above the median of its group's clusters; the only cluster of a group is stable.
    """
    c = clustered.where("cluster is not null").groupBy(group, "cluster").agg(F.avg(score).alias("_a"), F.avg(spread).alias("_v"))
    g = Window.partitionBy(group)
    c = c.withColumns({"_tier": F.row_number().over(g.orderBy(F.desc("_a"), "cluster")), "_mid": F.median("_v").over(g)})
    name = F.concat(F.col(group).cast("string"), F.lit("-tier"), F.col("_tier"), F.when(F.col("_v") > F.col("_mid"), "-volatile").otherwise("-stable"))
    c = c.select(F.col(group).alias("_g"), F.col("cluster").alias("_c"), name.alias("archetype"))
    out = clustered.join(c, F.col(group).eqNullSafe(F.col("_g")) & (F.col("cluster") == F.col("_c")), "left")
    return out.drop("_g", "_c")
