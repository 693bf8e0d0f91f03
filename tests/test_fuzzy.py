"""The similarity join of names and the resolution by it against all pairs."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import fuzzy

SCHEMA = "cls string, name string, id long, code string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def typo(rng, w, n):
    for _ in range(n):
        p = rng.randrange(len(w) + 1)
        w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abx ") + w[p:], w[:p] + rng.choice("ab") + w[p + 1 :]])
    return w


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(7)
    base = ["".join(rng.choice("aab bé") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 14, 20, 20, 26)] + ["aaaaaaaaaaaa", "abababababab"]
    known = [(rng.choice("pq"), typo(rng, rng.choice(base), rng.randrange(4)), i, rng.choice("cde")) for i in range(150)]
    asked = [(rng.choice("pq"), typo(rng, rng.choice(base), rng.randrange(4)), 1000 + i, None) for i in range(150)]
    known += [(None, "aaaa", 500, "c"), ("p", None, 501, "d"), known[0], ("p", "Twin Name", 502, None), ("p", "twin name ", 503, None)]
    asked += [(None, "aaaa", 2000, None), ("p", None, 2001, None), asked[0], ("p", "TWIN NAME", 2002, None), ("p", "Skins", 2003, None), ("p", "Nobody", 2004, None)]
    return known, asked


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_near_names(spark, tables, edits):
    known, asked = tables
    got = fuzzy.near_names(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(known, SCHEMA), ["cls"], "name", edits).collect()
    names = lambda rows: {(c, n) for c, n, *_ in rows if c is not None and n is not None}
    want = {(c, n, m) for c, n in names(asked) for d, m in names(known) if c == d and distance(n, m) <= edits}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_resolve(spark, tables):
    known, asked = tables
    nick = [("skins", "c"), ("skins", "c"), ("both", "c"), ("both", "d")]
    known = [*known, ("q", "the only one", 600, "z")]
    asked = [*asked, ("q", "Skins ", 2005, None), ("p", "both", 2006, None)]
    nicknames = spark.createDataFrame([*nick, ("z-men", "z")], "nickname string, code string")
    asked.append(("q", "Z-Men", 2007, None))
    special = F.col("id") >= 2003
    got = fuzzy.resolve(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(known, SCHEMA), ["cls"], "name", "id", edits=1, special=special, nicknames=nicknames).collect()
    want = []
    for c, n, i, _ in asked:
        mine = [(m.strip().lower(), j) for d, m, j, _ in known if m is not None and n is not None and c is not None and c == d]
        exact = {j for m, j in mine if m == (n or "").strip().lower()}
        near = {j for m, j in mine if distance(m, (n or "").strip().lower()) <= 1}
        if i >= 2003:
            found = (600, "nickname") if i == 2007 else (None, None)
        else:
            found = (min(exact), "exact") if len(exact) == 1 else (min(near), "fuzzy") if len(near) == 1 else (None, None)
        want.append((i, *found))
    assert sorted(((r.id, r.resolved, r.method) for r in got), key=str) == sorted(want, key=str)
    assert len(collections.Counter(m for *_, m in want)) == 4


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fuzzy.resolve(none, none, ["cls"], "name", "id").collect() == []


def test_resolve_deals_rows_and_puts_ids_of_a_name_together(spark):
    """Names that many share met with all their ids, and everything was dealt in the session's few partitions."""
    known = [("p", f"name {i % 5:03d} of many", i, "c") for i in range(200)] + [("p", "name 900 alone", 900, "c"), ("p", "nobody else", 901, "c")]
    asked = [("p", f"nme {i % 5:03d} of many", 2000 + i, None) for i in range(50)] + [("p", "nme 900 alone", 3000, None), ("p", "Nobody Else", 3001, None)]
    dealt = []
    deal = lambda df, *by: dealt.append(by) or df.repartition(7, *by)
    a, k = (spark.createDataFrame(x, SCHEMA) for x in (asked, known))
    out = fuzzy.resolve(a, k, ["cls"], "name", "id", edits=1, dealt=deal)
    got = {r.id: (r.resolved, r.method) for r in out.collect() if r.method}
    assert got == {3000: (900, "fuzzy"), 3001: (901, "exact")}
    assert ("cls", "_name") in dealt and ("cls", "_key") in dealt
    assert "distinct count" not in out._jdf.queryExecution().toString().lower().replace("count(distinct", "distinct count")
