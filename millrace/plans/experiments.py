"""Measured experiments on generated events: formats, joins, skew, shuffle partitions, reuse, functions in Python, file layout."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.sources import generators

HOT_SALTS = 16


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for a while; a double underscore stands for a dot."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def prepare(spark: SparkSession, path: str, rows: int, users: int) -> None:
    """The events as CSV, Parquet and Parquet by day, and the users."""
    generators.make_events(spark, rows, users).withColumn("event_date", F.to_date("event_ts")).write.mode("overwrite").parquet(f"{path}/events")
    events = spark.read.parquet(f"{path}/events")
    events.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    events.repartition("event_date").write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/by_day")
    generators.make_users(spark, users).write.mode("overwrite").parquet(f"{path}/users")


def experiments(spark: SparkSession, path: str) -> dict[str, Callable[[], None]]:
    """Each experiment by name, over what :func:`prepare` wrote."""
    events, users, by_day = spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/by_day")
    csv = spark.read.schema(events.schema).option("header", "true").csv(f"{path}/csv")
    total = lambda df: df.where("event_type = 'purchase'").agg(F.sum("amount").alias("amount"))
    by_country = lambda df: df.groupBy("country").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    off = {"adaptive__enabled": "false"}
    no_broadcast = {"autoBroadcastJoinThreshold": "-1"}

    def with_settings(build: Callable[[], DataFrame], **values: str) -> Callable[[], None]:
        def run() -> None:
            with settings(spark, **values):
                _run(build())

        return run

    def three(keep: bool) -> Callable[[], None]:
        def run() -> None:
            df = by_country(events.join(users, "user_id"))
            if keep:
                df = df.persist()
            for part in (df, df.where("n > 10"), df.agg(F.max("amount"))):
                _run(part)
            if keep:
                df.unpersist()

        return run

    @F.pandas_udf("double")
    def with_tax(amount: pd.Series) -> pd.Series:
        return amount * 1.1

    cold = events.where(F.col("user_id") != generators.HOT_USER)
    skewed = lambda: by_country(events.join(users, "user_id"))
    salted = lambda: by_country(joins.salted_join(events.select("user_id", "amount", "event_id"), users.select("user_id", "country"), "user_id", [generators.HOT_USER], HOT_SALTS, "inner", F.col("event_id")))
    by_user = lambda: events.groupBy("user_id").agg(F.sum("amount").alias("amount"))
    out = f"{path}/out"
    written = lambda df, *columns: df.write.mode("overwrite").partitionBy(*columns).parquet(out) if columns else df.write.mode("overwrite").parquet(out)
    return {
        "E1 CSV": lambda: _run(total(csv)), "E1 Parquet": lambda: _run(total(events)), "E1 one day": lambda: _run(total(by_day.where("event_date = DATE '2024-01-15'"))),
        "E2 sort-merge": with_settings(lambda: by_country(cold.join(users, "user_id")), **off, **no_broadcast), "E2 broadcast": with_settings(lambda: by_country(cold.join(joins.broadcast_if_small(users), "user_id")), **off),
        "E3 naive": with_settings(skewed, **off, **no_broadcast, shuffle__partitions="16"), "E3 adaptive": with_settings(skewed, **no_broadcast, shuffle__partitions="16", adaptive__advisoryPartitionSizeInBytes="8MB", adaptive__skewJoin__skewedPartitionThresholdInBytes="8MB"),
        "E3 salted": with_settings(salted, **off, **no_broadcast, shuffle__partitions="16"),
        "E4 2000": with_settings(by_user, **off, shuffle__partitions="2000"), "E4 200": with_settings(by_user, **off, shuffle__partitions="200"), "E4 8": with_settings(by_user, **off, shuffle__partitions="8"), "E4 2000 adaptive": with_settings(by_user, shuffle__partitions="2000"),
        "E5 anew": three(False), "E5 kept": three(True),
        "E6 native": lambda: _run(events.agg(F.sum(F.col("amount") * 1.1))), "E6 Python": lambda: _run(events.agg(F.sum(with_tax("amount")))),
        "E7 as it is": lambda: written(events, "event_date"), "E7 by day": lambda: written(events.repartition("event_date"), "event_date"), "E7 two files": lambda: written(events.coalesce(2)),
    }


def measure(spark: SparkSession, path: str, rows: int = 10_000_000, users: int = 200_000) -> dict[str, float]:
    """Seconds of each experiment: the best of two runs of E1, E2 and E6, one run of the others, as they are published."""
    prepare(spark, path, rows, users)
    out = {}
    for name, run in experiments(spark, path).items():
        best = float("inf")
        for _ in range(2 if name[:2] in ("E1", "E2", "E6") else 1):
            start = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - start)
        out[name] = round(best, 3)
    return out
