"""Every query of the library against DuckDB."""

import pytest

import __spark_entry__ as entry
from millrace import catalog
from tests.oracle import connect, from_duckdb, from_spark


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, data, name):
    df = catalog.QUERIES[name](spark, data)
    got = from_spark(df)
    if name in catalog.ORACLES:
        out = con.execute(catalog.ORACLES[name])
        assert sorted(d[0] for d in out.description) == sorted(df.columns)
        assert got == from_duckdb(con, catalog.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
