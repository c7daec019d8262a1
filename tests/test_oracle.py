"""Every registered query against its SQL, over whole small tables."""

import pytest

import __spark_entry__ as spark_entry
import oracle
from textquarry.workload import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = oracle.connect(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLES[name]) is None


def test_entry_returns_rows(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(spark_entry.queries())
