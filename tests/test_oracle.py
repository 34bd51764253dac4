"""Every query with a SQL twin, compared with DuckDB on the smallest tables."""

import pytest

from candlewright.plans.registry import QUERIES, SQL
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, con, name):
    _, _, problem = compare(spark, con, name, FOLDER, QUERIES[name], SQL[name])
    assert problem is None


def test_only_streams_lack_a_twin():
    assert all(n.startswith("stream_") for n in set(QUERIES) - set(SQL))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
