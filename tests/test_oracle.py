"""Every query with SQL gives the rows that DuckDB gives; every other query runs."""

import oracle
import pytest

from gleanery.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.database(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf_dir), con, registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
