"""Every registered query of the library against its SQL on the smallest tables; ``tests/compare.py`` runs them on larger ones."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from confsieve.plans import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], FOLDER) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) == set(ORACLES)
