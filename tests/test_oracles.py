"""Every query with a SQL counterpart gives the same rows in both engines."""

import pytest

import __spark_entry__ as entry
from engines import compare, duck
from oracle import all_oracles
from sparkwarden.plans.queries import all_queries

SF = "/root/testdata/sf0.001"
ORACLES = all_oracles()
QUERIES = all_queries()
ROWS_ONLY = {"suspicious_findings", "config_commands"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_covered():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
