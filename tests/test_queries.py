"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from trailframe.catalog.registry import load

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, con.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() == 1000
