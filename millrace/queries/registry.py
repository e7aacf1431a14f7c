"""A registry of queries: each is a function of named tables, with the SQL that checks it."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.tables import load_table


class Registry:
    """``@q("ID", sql)`` on a function whose arguments are table names (or ``spark``, ``folder``)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            wanted = list(inspect.signature(f).parameters)

            def run(spark: SparkSession, folder: str) -> DataFrame:
                given = {"spark": spark, "folder": folder}
                return f(*[given[w] if w in given else load_table(spark, folder, w) for w in wanted])

            assert name not in self.queries, name
            run.__doc__ = f.__doc__
            self.queries[name] = run
            if sql:
                self.oracles[name] = sql
            return f

        return add

    def sql(self, name: str, text: str, oracle: str | None = None, tables: str = "") -> None:
        """A query written in SQL that both engines read alike, or in Spark's dialect beside its ``oracle``."""
        wanted = tables.split()

        def run(spark: SparkSession, folder: str) -> DataFrame:
            for t in wanted:
                load_table(spark, folder, t).createOrReplaceTempView(t)
            return spark.sql(text)

        assert name not in self.queries, name
        self.queries[name] = run
        self.oracles[name] = oracle or text
