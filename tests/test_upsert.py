"""The keyed upsert that keeps what others filled in."""

from __future__ import annotations

import pytest

from pitpanel.sources import tables as T

KIND = "y int, m int, spent double, n long"


def rows(spark, path):
    return {(r.y, r.m): (r.spent, r.n, r.note, r.best) for r in T.read(spark, path).collect()}


def test_upsert(spark):
    path = T.workspace(spark)
    put = lambda data: T.upsert(spark.createDataFrame(data, KIND), path, ["y", "m"], ["y"], {"note": "new", "best": 0.0})
    put([(1, 1, 5.0, 1), (1, 2, 6.0, 2), (2, 1, 7.0, 3)])
    assert rows(spark, path) == {(1, 1): (5.0, 1, "new", 0.0), (1, 2): (6.0, 2, "new", 0.0), (2, 1): (7.0, 3, "new", 0.0)}
    T.set_manual(spark.createDataFrame([(1, 2, "mine", 9.5), (1, 7, "no such row", 1.0), (2, 1, None, 3.0)], "y int, m int, note string, best double"), path, ["y", "m"], ["y"], ["note", "best"])
    after = {(1, 1): (5.0, 1, "new", 0.0), (1, 2): (6.0, 2, "mine", 9.5), (2, 1): (7.0, 3, None, 3.0)}
    assert rows(spark, path) == after
    files = {f for f in spark.read.parquet(path).inputFiles() if "/y=2/" in f}
    for _ in range(2):
        put([(1, 2, 60.0, None), (1, 3, 8.0, 4)])  # a second run changes nothing
        assert rows(spark, path) == {**after, (1, 2): (60.0, None, "mine", 9.5), (1, 3): (8.0, 4, "new", 0.0)}
    assert {f for f in spark.read.parquet(path).inputFiles() if "/y=2/" in f} == files  # slices without rows are not written
    put([])
    assert len(rows(spark, path)) == 4


def test_what_cannot_be_merged(spark):
    path = T.workspace(spark)
    for data in ([(1, 1, 5.0, 1), (1, 1, 6.0, 1)], [(None, 1, 5.0, 1)]):
        with pytest.raises(T.ConflictError):
            T.upsert(spark.createDataFrame(data, KIND), path, ["y", "m"], ["y"], {"note": "new"})
    assert T.found(spark, path) is None
