"""Spines: rows that must be there whether or not something was observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upcoming_rows(panel: DataFrame, upcoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """panel and a row, null but for its keys, for each upcoming key that it lacks."""
    new = upcoming.select(*keys).distinct().join(panel.select(*keys), list(keys), "left_anti")
    return panel.unionByName(new, allowMissingColumns=True)


def from_schedule(schedule: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for every scheduled or observed key; nulls where nothing was observed."""
    spine = schedule.select(*keys).union(observed.select(*keys)).distinct()
    return spine.join(observed, list(keys), "left")


def sides_to_long(games: DataFrame, id_col: str, sides: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per game to one per side, in one scan. sides: name -> columns of that side's row."""
    rows = [F.struct(F.lit(s).alias("side"), *[c.alias(k) for k, c in cols.items()]) for s, cols in sides.items()]
    return games.select(id_col, F.inline(F.array(*rows)))


def grid(units: DataFrame, roles: DataFrame, events: DataFrame, on: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Every unit with every role (roles: a fixed few rows), with zeros where no event was."""
    dense = units.crossJoin(F.broadcast(roles)).join(events, list(on), "left")
    return dense.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
