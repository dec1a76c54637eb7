"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools import verify

SMALL = os.environ.get("HYDROFLOW_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return verify.connect(SMALL)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["site", "station", "date", "value", "value_7d"] and df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 150


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ok, message = verify.compare(spark, duck, name, SMALL, show=True)
    assert ok, message
