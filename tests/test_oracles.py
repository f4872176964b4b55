"""Every bound query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        result = compare(df, con, ORACLES[name])
        assert result.startswith("ok"), result
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 11
