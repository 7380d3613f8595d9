"""Every registered query of the engine against DuckDB, whole tables."""

import pytest

from gavelspark.plans.queries import ORACLE, QUERIES

from .support import MIDDLE, assert_same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, MIDDLE), MIDDLE, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    QUERIES[name](spark, MIDDLE).collect()
