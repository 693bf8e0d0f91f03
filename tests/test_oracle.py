"""Every query with SQL gives the SQL's rows."""

import pytest

from conftest import compare
from pitpanel.plans import registry

FOUND, WANTED = registry.collect()


@pytest.mark.parametrize("name", sorted(WANTED))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, FOUND[name], WANTED[name]) == ""


def test_every_sql_has_a_query():
    assert set(WANTED) <= set(FOUND)
