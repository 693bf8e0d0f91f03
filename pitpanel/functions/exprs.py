"""Column expressions: null-safe arithmetic, codes, keys, tiers, hashes and weights. All run inside Catalyst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(c: Column, table: Mapping, default: Column | None = None) -> Column:
    """The value of a small literal table, else the default (c itself if none is given)."""
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(m, c), c if default is None else default)


def ladder(c: Column, steps: Sequence[tuple[float, object]], top: object) -> Column:
    """The label of the first bound that c is under, else top; null for null."""
    out = None
    for bound, label in steps:
        out = F.when(c < bound, F.lit(label)) if out is None else out.when(c < bound, F.lit(label))
    return out.when(c.isNotNull(), F.lit(top))


def weighted(weights: Mapping[str, float], bonuses: Sequence[tuple[str, float, float]] = ()) -> Column:
    """Sum of weight times column, and bonus where a column reaches a bound; nulls count as zero."""
    terms = [F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()]
    terms += [F.when(F.col(c) >= bound, bonus).otherwise(0) for c, bound, bonus in bonuses]
    return sum(terms[1:], terms[0])


def active_or_null(active: Column, x: Column) -> Column:
    """Zero only where active: not available is null, active without an event is 0."""
    return F.when(active, F.coalesce(x, F.lit(0)))


def supported(support: Column, least: int, x: Column) -> Column:
    return F.when(support >= least, x)


def remainder(total: Column, own: Column, rate: Column) -> Column:
    """What is left of a total without oneself, not below zero, times a capture rate."""
    return F.greatest(total - own, F.lit(0)) * rate


def row_hash(*cols: str) -> Column:
    """SHA-256 of the columns as text, in the given order; nulls are told from empty strings."""
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("|", *text), 256)


def hash_bucket(c: Column, n: int) -> Column:
    """0..n-1 from the MD5 of the value as text: the same rows in every run and engine."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % n


def mean_nonnull(*cols: str) -> Column:
    kept = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))


def implied_probability(price: Column) -> Column:
    """Probability implied by an American price."""
    return F.when(price > 0, 100 / (price + 100)).when(price < 0, -price / (100 - price))


def devig(p: Column, q: Column) -> Column:
    return F.try_divide(p, p + q)


def blend(a: Column, b: Column, w: float) -> Column:
    """w * a + (1 - w) * b, and a where b is null."""
    return F.coalesce(w * a + (1 - w) * b, a)


def half_life(age: Column, h: float) -> Column:
    return F.when(age >= 0, F.pow(F.lit(0.5), age / h))


def strip_markup(c: Column) -> Column:
    """Text of an excerpt of HTML: scripts, styles, comments and tags removed, blanks squeezed."""
    x = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


# fixed values: the published rational approximation of the normal quantile (Abramowitz and Stegun, 26.2.23)
_C, _D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)


def normal_mean(p: Column, point: Column, sd: float) -> Column:
    """Mean of a normal variable of deviation sd that is above point with probability p."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - (_C[0] + _C[1] * t + _C[2] * t * t) / (1 + _D[0] * t + _D[1] * t * t + _D[2] * t * t * t)
    return point + sd * F.when(p >= 0.5, z).otherwise(-z)


def poisson_mean(p: Column, point: Column, rounds: int = 40, most: float = 50.0) -> Column:
    """Mean (0..most) of a Poisson variable that is above point, no whole number, with probability p, by halving."""

    def at_most(mean: Column) -> Column:
        terms = F.sequence(F.lit(0), F.floor(point).cast("int"))
        step = lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * mean / (k + 1)).alias("term"))
        return F.aggregate(terms, F.struct(F.lit(0.0).alias("sum"), F.exp(-mean).alias("term")), step, lambda s: s["sum"])

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = 1 - at_most(mid) < p
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    ends = F.struct(F.lit(0.0).alias("lo"), F.lit(most).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), ends, halve, lambda s: s["lo"])


# fixed values: the published polynomial approximation of the normal distribution (Abramowitz and Stegun, 26.2.17)
NORMAL = (0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429))


def normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / F.sqrt(2 * F.pi())


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution, right to seven digits."""
    t = 1 / (1 + NORMAL[0] * F.abs(z))
    tail = F.lit(0.0)
    for b in reversed(NORMAL[1]):
        tail = t * (b + tail)
    tail = normal_density(z) * tail
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_crps(y: Column, mean: Column, sd: Column) -> Column:
    """Closed-form CRPS of a normal forecast."""
    z = (y - mean) / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * normal_density(z) - 1 / F.sqrt(F.pi()))


def normal_cdf_sql(z: str) -> str:
    """normal_cdf as SQL text."""
    t = f"(1 / (1 + {NORMAL[0]} * abs({z})))"
    tail = "0.0"
    for b in reversed(NORMAL[1]):
        tail = f"{t} * ({b} + {tail})"
    tail = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {tail}"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"
