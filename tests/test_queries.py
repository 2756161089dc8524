"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from treeline.catalog import load

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load().QUERIES, load().ORACLES

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "size", "files", "total_size", "saveable_size", "survivor"]
    assert df.count() > 0
