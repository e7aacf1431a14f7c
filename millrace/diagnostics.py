"""Reading plans and runs: what was pushed down, how evenly partitions fill, how long things take."""

from __future__ import annotations

import contextlib
import io
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def plan_lines(df: DataFrame, pattern: str) -> list[str]:
    return [line.strip() for line in plan_text(df).splitlines() if re.search(pattern, line)]


def count_exchanges(df: DataFrame) -> int:
    return len(re.findall(r"^\(\d+\) (?:Broadcast)?Exchange", plan_text(df), re.M))


def partition_skew(df: DataFrame, column: str, partitions: int) -> DataFrame:
    """Rows of the fullest and the middle partition if rows are dealt out by a column, and their ratio."""
    n = df.select(F.pmod(F.hash(column), F.lit(partitions)).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("most"), F.percentile("n", 0.5).cast("long").alias("middle")).withColumn("ratio", F.round(F.col("most") / F.col("middle"), 2))


def timed(build: Callable[[], DataFrame], runs: int = 2) -> float:
    """The best time of some runs, each of a DataFrame built anew, into the noop sink."""
    best = float("inf")
    for _ in range(runs):
        t = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - t)
    return best


def stage_stats(spark) -> list[dict]:
    """Tasks and times by stage from the status store; needs no web UI."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(spark._jvm, "java").lang.reflect.Array.newInstance(spark._jvm.java.lang.Double.TYPE, 0), None)
    return [{"stage": s.stageId(), "tasks": s.numCompleteTasks(), "run_ms": s.executorRunTime(), "shuffle_write": s.shuffleWriteBytes()} for s in (stages.apply(i) for i in range(stages.size()))]


def profile(df: DataFrame) -> DataFrame:
    """``column, rows, nulls, distinct`` for every column, in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), F.countDistinct(c).alias("distinct")) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
