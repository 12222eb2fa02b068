"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect
from notegraph.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    same, detail = compare(spark, connection, FOLDER, name)
    assert same, detail


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["path", "similar_path", "similarity", "rank"]
    assert result.count() == 1000
