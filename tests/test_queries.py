"""Every registered query on the smallest tables, against DuckDB where it has SQL."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert differences(got, duck.execute(ORACLES[name]).df(), exact=False) == []
    else:
        assert list(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
