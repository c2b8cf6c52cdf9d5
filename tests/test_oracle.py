"""Every query against its independent SQL formulation."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from hand import SF
from spendlens.catalog import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[-1] == "scalability_decision"
