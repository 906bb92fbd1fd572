"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checker import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# Whole plans with model stages; their parts are checked one by one.
WITHOUT_SQL = {"split_documents", "answer_plan", "explain_plan", "evaluation_plan", "stream_answers"}


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - set(entry.ORACLES)))
def test_query_without_sql(spark, name):
    assert name in WITHOUT_SQL
    assert entry.QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 6 * 40
