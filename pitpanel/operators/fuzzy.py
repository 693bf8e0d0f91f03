"""Similarity join of names by q-gram prefixes, and resolution that takes a fuzzy match only if it is the only one."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q = 2


def _grams(name: Column) -> Column:
    """The grams of a name, each with how often it has come before in it: equal grams count apart."""
    all_of = F.transform(F.sequence(F.lit(1), F.length(name) - (Q - 1)), lambda i: F.substr(name, i, F.lit(Q)))
    return F.transform(all_of, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(all_of, 1, i + 1), lambda x: x == g)).alias("nth")))


def _shorter(name: Column, edits: int, most: int) -> Column:
    """The name and what is left of it without up to `edits` of its characters, for names of up to `most`."""
    kinds = [name]
    for n in range(1, edits + 1):
        for gone in combinations(range(most), n):
            cut = name
            for p in reversed(gone):
                cut = F.concat(F.substr(cut, F.lit(1), F.lit(p)), F.substr(cut, F.lit(p + 2)))
            kinds.append(F.when(F.length(name) > gone[-1], cut))
    return F.array_distinct(F.array_compact(F.array(*kinds)))


def near_names(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str, edits: int, dealt=None) -> DataFrame:
    """(keys, name_l, name_r): pairs of distinct names within equal keys and `edits` edits of each other, equal ones too.

    A name of n characters has n - 1 grams of two; an edit takes away two at most. So names within reach share all but
    2 * edits of either's grams, and one of the 2 * edits + 1 rarest of either: only those are joined. Names too short
    to have more grams than that share what is left of them without up to `edits` characters. Names that meet are
    verified by edit distance. Null keys and names match nothing.
    dealt(rows, *columns): rows by hash of columns in as many partitions as there is memory for; the session's if left out.
    """
    dealt = dealt or (lambda df, *by: df)
    few = Q * edits + 1
    short = few + Q - 1 + edits  # up to here a partner may have no more than `few` grams

    def names(df: DataFrame) -> DataFrame:
        return dealt(df.select(*keys, F.col(name).alias("_name")).where(F.col("_name").isNotNull()), *keys, "_name").distinct()

    both = {"l": names(left), "r": names(right)}
    gram = lambda df: df.where(F.length("_name") >= few + Q - 1).select(*keys, "_name", F.inline(_grams(F.col("_name"))))
    uses = gram(both["r"]).groupBy("gram").agg(F.count("*").alias("uses"))
    met = {}
    for side, df in both.items():
        rarest = Window.partitionBy(*keys, "_name").orderBy(F.coalesce("uses", F.lit(0)), "gram", "nth")
        ranked = dealt(gram(df).join(uses, "gram", "left"), *keys, "_name")
        prefix = ranked.withColumn("_k", F.row_number().over(rarest)).where(F.col("_k") <= few)
        long = prefix.select(*keys, F.concat_ws(":", F.lit("g"), "gram", "nth").alias("_key"), F.col("_name").alias(f"name_{side}"))
        rest = df.where(F.length("_name") <= short).select(*keys, F.explode(_shorter(F.col("_name"), edits, short)).alias("_s"), F.col("_name").alias(f"name_{side}"))
        met[side] = long.unionByName(rest.select(*keys, F.concat_ws(":", F.lit("s"), "_s").alias("_key"), f"name_{side}"))
    met = {side: dealt(df, *keys, "_key") for side, df in met.items()}
    near = met["l"].join(met["r"], [*keys, "_key"]).where(F.levenshtein("name_l", "name_r", edits) >= 0)
    return near.select(*keys, "name_l", "name_r").distinct()


def resolve(asked: DataFrame, known: DataFrame, keys: Sequence[str], name: str, id_col: str, *, edits: int = 2, special: Column | None = None, nicknames: DataFrame | None = None, code: str = "code", dealt=None) -> DataFrame:
    """asked with resolved and method: 'exact', 'fuzzy', 'nickname', or null where no one candidate is left.

    Within equal keys a row of known (keys, name, id_col) with the same name, lower-cased and trimmed, is taken if its id
    is the only one; else one within `edits` edits, if that is the only one. Rows of asked where `special` holds are
    resolved by nicknames alone: (nickname, code) says whose name a nickname is, and known's `code` column who has that code.
    Whether a candidate is the only one shows in the least and the largest id: ids of a name are put together before
    names meet, so a name that many share is one row. dealt: as in near_names.
    """
    dealt = dealt or (lambda df, *by: df)
    plain = lambda c: F.lower(F.trim(c))
    a = asked.withColumn("_name", plain(F.col(name)))
    a = a.withColumn("_special", F.coalesce(special, F.lit(False)) if special is not None else F.lit(False))
    k = known.withColumn("_name", plain(F.col(name)))

    def ends(df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.min(id_col).alias("_low"), F.max(id_col).alias("_high"))

    def one(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
        g = df.groupBy(*by).agg(F.min("_low").alias("_low"), F.max("_high").alias(out))
        return g.where(F.col("_low") == F.col(out)).drop("_low")

    a = dealt(a, *keys, "_name")
    usual = a.where("not _special")
    ids = ends(dealt(k, *keys, "_name"), [*keys, "_name"])
    exact = one(ids, [*keys, "_name"], "_exact")
    open_names = usual.join(exact, [*keys, "_name"], "left_anti").select(*keys, "_name")
    near = near_names(open_names, k, keys, "_name", edits, dealt)
    whose = near.join(ids.withColumnRenamed("_name", "name_r"), [*keys, "name_r"])
    fuzzy = one(whose.withColumnRenamed("name_l", "_name"), [*keys, "_name"], "_fuzzy")
    out = usual.join(exact, [*keys, "_name"], "left").join(fuzzy, [*keys, "_name"], "left").withColumn("_nick", F.lit(None).cast(known.schema[id_col].dataType))
    if nicknames is not None:
        coded = nicknames.select(plain(F.col("nickname")).alias("_name"), F.col(code).alias("_code")).distinct()
        coded_ids = one(ends(k.where(F.col(code).isNotNull()).withColumn("_code", F.col(code)), [*keys, "_code"]), [*keys, "_code"], "_nick")
        by_nick = one(coded.join(coded_ids, "_code").withColumns({"_low": F.col("_nick"), "_high": F.col("_nick")}).drop("_nick"), [*keys, "_name"], "_nick")
        rest = a.where("_special").join(by_nick, [*keys, "_name"], "left")
    else:
        rest = a.where("_special").withColumn("_nick", F.lit(None).cast(known.schema[id_col].dataType))
    out = out.unionByName(rest, allowMissingColumns=True)
    method = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_fuzzy").isNotNull(), "fuzzy").when(F.col("_nick").isNotNull(), "nickname")
    return out.select(*asked.columns, F.coalesce("_exact", "_fuzzy", "_nick").alias("resolved"), method.alias("method"))
