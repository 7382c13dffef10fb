"""Every query with SQL against DuckDB, on the whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences
from tideline.plans.catalog import QUERIES
from tideline.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, con):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(ORACLE) <= set(oracle_sql()) and set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 131
