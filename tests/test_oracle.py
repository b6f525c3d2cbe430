"""Every core query runs on the smallest data and equals its SQL twin."""

import pytest

import __spark_entry__
from kvizmill.plans import registry
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.SQL:
        assert differences(df, con, registry.SQL[name]) is None
    else:
        assert df.limit(5).count() >= 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["category", "sort_order", "count", "pct"] and df.count() > 0


def test_names_are_those_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
