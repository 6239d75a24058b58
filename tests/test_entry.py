"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from tests.oracle import compare, connect

import __spark_entry__ as entry
from suite.oracles import ORACLES
from suite.spark_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["source", "n"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert problem is None
