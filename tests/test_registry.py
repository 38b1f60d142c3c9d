"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
import check_oracle

from callscope.plans import oracle, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return check_oracle.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert check_oracle.compare(spark, connection, name, QUERIES[name], SQL.get(name), SF) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 3


def test_only_learning_lacks_sql():
    assert set(QUERIES) - set(SQL) == {"lr_scores"}
    assert not set(SQL) - set(QUERIES)


def test_contract_holds_all_core_queries():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
