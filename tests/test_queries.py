"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, views

CORE = sorted(n for n in entry.queries() if n.startswith("q_"))


@pytest.fixture(scope="module")
def con():
    return views(DATA)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert not compare(spark, name, query, sql, DATA, con)
    else:
        # The smallest tables are too small for lifecycles of weekly terms.
        assert query(spark, DATA).count() > 0 or name == "q_pipeline_lifecycle"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["feature", "ts", "count", "trend_state", "decay_confidence"] and df.count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
