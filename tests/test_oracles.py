"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from lumapanel.plans import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()

# On the smallest tables some filters keep nothing; the results must still agree.


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    found = differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert [f for f in found if f != "no rows"] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 25


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())
