"""Every registered query with SQL gives the same rows as DuckDB, at the smallest size."""

import parity
import pytest

from lodestrata.plans import registry

D = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert parity.same(registry.queries()[name](spark, D), D, SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, D).count() > 0
