"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import rows

from ratingloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
