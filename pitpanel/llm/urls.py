"""URL filters: host and path rules, and a Bloom filter cascade for listed hosts.

The cascade's first level holds the listed keys. The next holds the other keys of the corpus that the first lets
through, the one after that the listed keys which the second lets through, and so on until a level lets nothing
through wrongly. Over that complete universe of keys, a key is listed exactly if the first level that lacks it is
an even one (counted from 1), so no join is needed to look keys up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.store import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A host is listed if one of its names has one of these words among its parts.
WORDS = (
    *("spam", "farm", "warez", "malware", "phish", "clickbait"),
    *("casino", "bet", "bets", "betting", "gambling", "poker"),
    *("ad", "ads", "adverts", "tracker", "track"),
    *("pill", "pills", "viagra", "adult", "porn", "xxx"),
)
BITS_PER_KEY, HASHES, MOST_KEYS = 12, 5, 4_000_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def listed_hosts(hosts: DataFrame, words=WORDS) -> DataFrame:
    """The hosts (column host) that have a listed word as a part between dots and hyphens."""
    return hosts.where(F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, words))))


def _place(key: Column, level: int, i: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(n_bits))


def _filter_of(keys: DataFrame, level: int, n_bits: int) -> Column:
    """An array<long> of the filter's bits, as a scalar subquery: every word, the empty ones from a range, in order."""
    at = F.explode(F.array(*[_place(F.col("host"), level, i, n_bits) for i in range(HASHES)]))
    some = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    none = keys.sparkSession.range(n_bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(none).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    made = words.agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("m"))
    return made.select(F.transform("m", lambda x: x["bits"])).scalar()


def _shard(key: Column, level: int, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 64 + HASHES)), F.lit(shards))


def _has(bits: Column, key: Column, level: int, n_bits: int) -> Column:
    out = F.lit(True)
    for i in range(HASHES):
        at = _place(key, level, i, n_bits)
        word = F.get(bits, F.shiftright(at, 6).cast("int"))
        out = out & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


class Cascade:
    """Exact membership of hosts of `universe` (column host) in `listed`.

    With no listed host, and for an empty universe, there is no level and nothing is listed. A level of over
    `most_keys` keys is dealt out to shards by hash, each with a filter of its own.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, most_keys: int = MOST_KEYS):
        universe = materialise(universe.select("host").distinct())
        listed = materialise(listed.select("host").distinct())
        inside, outside = listed, universe.join(listed, "host", "left_anti")
        self.levels: list[tuple[list[Column], int]] = []
        n = inside.count()
        while n:
            shards = -(-n // most_keys)
            n_bits = 64 * max(1, -(-n * BITS_PER_KEY // (64 * shards)))
            level = len(self.levels)
            parts = [inside] if shards == 1 else [inside.where(_shard(F.col("host"), level, shards) == i) for i in range(shards)]
            self.levels.append(([_filter_of(part, level, n_bits) for part in parts], n_bits))
            wrong = materialise(outside.where(self._passes(F.col("host"), level)))
            inside, outside = wrong, inside
            n = inside.count()

    def _passes(self, key: Column, level: int) -> Column:
        """Whether a level's filter lets key through; the shard number chooses the filter."""
        filters, n_bits = self.levels[level]
        out = _has(filters[-1], key, level, n_bits)
        for i, bits in enumerate(filters[:-1]):
            out = F.when(_shard(key, level, len(filters)) == i, _has(bits, key, level, n_bits)).otherwise(out)
        return out

    def has(self, key: Column) -> Column:
        """Whether key, one of the universe, is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def judge_urls(
    pages: DataFrame, listed: DataFrame | None = None, *, rules=RULES, words=WORDS, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id long, host, path, rule, verdict strings, listed boolean), a row for each row of pages.

    The longest rule that fits gives the verdict; else block for listed hosts and allow for others. listed: a table
    of them (host), of which those that no page has are not looked at; if it is not given, the hosts that
    listed_hosts finds among the pages'. Without any listed host, none is. An empty table gives no rows. Null urls, and those without ://, have an empty host and path, fit no rule and are allowed. Null ids and
    repeated rows are kept as they are; other columns are not looked at.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    universe = materialise(rows.select("host").distinct())
    if listed is None:
        listed = listed_hosts(universe, words)
    else:
        listed = listed.select("host").join(universe, "host", "left_semi")
    cascade = Cascade(universe, listed)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    out = rows.withColumn("listed", cascade.has(F.col("host")))
    block = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, block).alias("verdict"), "listed")
