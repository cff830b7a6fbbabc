"""Every registered query against its oracle; rows-only ones must run."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from workload import more_queries as _more, rule_queries as _rules  # noqa: F401  (register their queries)
from workload import queries as _queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = _queries.QUERIES, _queries.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert difference(spark, con, QUERIES[name], ORACLES[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
