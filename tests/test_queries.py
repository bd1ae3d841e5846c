"""Every query against its oracle; queries without one must run and keep their schema."""

import pytest

from compare import connect, same
from rowproof.queries import flagship, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, sf, con):
    df = queries()[name](spark, sf)
    if name in oracle_sql():
        same(df, con, oracle_sql()[name])
    else:
        assert df.columns and df.limit(5).collect() is not None


def test_flagship(spark, sf):
    rows = flagship(spark, sf).collect()
    assert rows and {r["processing_category"] for r in rows} <= {"tool_fixable", "reextraction"}
