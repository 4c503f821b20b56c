"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as spark_entry
from apportion import catalog
from compare import connect, difference

QUERIES = spark_entry.queries()
SQL = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), duck.sql(SQL[name])) is None


def test_every_query_of_the_catalog_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry_has_all_cells(spark):
    assert spark_entry.entry(spark).count() == 9
