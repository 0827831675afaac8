"""Every query with SQL gives the SQL's rows."""

import compare
import pytest

from wheeltrace.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, data, con, name):
    assert compare.differences(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
