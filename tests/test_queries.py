"""Registered queries against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from fixtures.queries import ORACLE, QUERIES, SLOW
from oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys() | SLOW.keys()
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, SLOW.get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).columns == ["cell_id", "n"]
