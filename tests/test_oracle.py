"""Every registered query against its SQL at the smallest scale."""

import pytest
from compare import connect, mismatch

import __spark_entry__ as entry
from oracles import all_oracles
from queries import all_queries

# the queries of the optional subpackage have tests of their own
QUERIES, SQL = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == {"explanations", "run_record", "content_identity"}
    assert not set(SQL) - set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    assert mismatch(spark, con, QUERIES[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
