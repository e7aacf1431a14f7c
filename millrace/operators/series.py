"""Time series and behaviour: islands, gaps, sessions, cohorts, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(days: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days of each key: ``start``, ``end``, ``days``."""
    w = Window.partitionBy(key).orderBy(day)
    marked = days.select(key, day).distinct().withColumn("__grp", F.date_sub(day, F.row_number().over(w)))
    return marked.groupBy(key, "__grp").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("days")).drop("__grp")


def calendar(spark, first: str, last: str) -> DataFrame:
    """One row for each ``day``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def fill_gaps(daily: DataFrame, key: str, day: str, value: str, first: str, last: str) -> DataFrame:
    """Every key on every day of a span, with 0 where nothing was recorded. The grid is made key by key, without a cross join."""
    grid = daily.select(key).distinct().select(key, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    return grid.join(daily, [key, day], "left").select(key, day, F.coalesce(value, F.lit(0)).alias(value))


def sessions(events: DataFrame, key: str, time: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of activity with no pause longer than the gap: ``session_start``, ``session_end``, ``n_events``."""
    w = Window.partitionBy(key).orderBy(time)
    pause = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(w))
    marked = events.withColumn("__n", F.sum(F.when(pause > gap_minutes * 60, 1).otherwise(0)).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__n").agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count("*").alias("n_events")).drop("__n")


def ordered_funnel(events: DataFrame, key: str, time: str, step: str, steps: list[str]) -> DataFrame:
    """Keys that reach each step after the one before: one row of counts."""
    agg = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(step).alias("s")))).alias("seq"))
    # the furthest step is a fold over the sequence: it moves on when the next step's name comes
    names = F.array(*[F.lit(s) for s in steps])
    depth = F.aggregate("seq", F.lit(0), lambda a, x: F.when((a < len(steps)) & (F.get(names, a) == x["s"]), a + 1).otherwise(a))
    agg = agg.select(depth.alias("depth"))
    return agg.agg(*[F.count(F.when(F.col("depth") > i, 1)).alias(f"reached_{s}") for i, s in enumerate(steps)])


def cohort_retention(df: DataFrame, key: str, day: str) -> DataFrame:
    """``cohort`` (month of a key's first day), ``age`` in months and ``n`` keys active."""
    first = df.groupBy(key).agg(F.min(day).alias("__first"))
    months = lambda c: F.year(c) * 12 + F.month(c)
    each = df.join(first, key).select(key, F.date_format("__first", "yyyy-MM").alias("cohort"), (months(F.col(day)) - months(F.col("__first"))).alias("age")).distinct()
    return each.groupBy("cohort", "age").agg(F.count("*").alias("n"))
