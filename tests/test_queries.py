import importlib.util

import pytest

import __spark_entry__ as entry
from fieldspan import more_queries, queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf_dir, compare):
    compare(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered_queries_are_callable():
    assert all(callable(f) for f in entry.queries().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_nothing_but_the_entry_needs_the_optional_subpackage():
    assert importlib.util.find_spec("fieldspan.queries") is not None

