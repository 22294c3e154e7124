"""Every registered query against its SQL oracle, over whole tables."""

import os

import pytest

import __spark_entry__ as contract
from compare import connect, differences

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(con, QUERIES[name](spark, FOLDER), SQL[name]) == []


def test_entry_runs(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    result = contract.entry(spark)
    assert result.columns == ["Product", "mean_smape"] and result.count() == 5
