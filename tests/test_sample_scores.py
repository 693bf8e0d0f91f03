"""Scores of samples where a value lies midway between two decimals, or an actual value on a quantile."""

import random

import duckdb

from conftest import rows_of
from pitpanel.plans import registry


def test_sample_scores_on_ties(spark, tmp_path):
    r, rows = random.Random(5), []
    for b in range(3000):
        n = (5, 7, 16)[b % 3]
        rows += [(b, k, float(r.randint(1, 12 if n == 7 else 50))) for k in range(n)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (b BIGINT, k INTEGER, q DOUBLE)")
    values = ",".join(map(str, rows))
    con.execute(f"INSERT INTO t VALUES {values}")
    path = f"{tmp_path}/lineitem.parquet"
    con.execute(f"""COPY (SELECT b AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, k AS l_linenumber, q AS l_quantity, 1.0::DOUBLE AS l_extendedprice,
      0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1995-01-01' AS l_shipdate FROM t) TO '{path}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    found, wanted = registry.collect()
    df = found["eval_sample_scores"](spark, str(tmp_path))
    cur = con.execute(wanted["eval_sample_scores"])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert set(rows_of(df.columns, df.collect())) ^ set(want) == set()
