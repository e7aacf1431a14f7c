"""The training-data queries that SQL can express, against DuckDB."""

import pytest

from millrace.llm import queries
from tests.oracle import connect, from_duckdb, from_spark


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, data, name):
    con = connect(data)
    df = queries.QUERIES[name](spark, data)
    assert sorted(d[0] for d in con.execute(queries.ORACLES[name]).description) == sorted(df.columns)
    assert from_spark(df) == from_duckdb(con, queries.ORACLES[name])
