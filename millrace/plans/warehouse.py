"""Dimensional models: dates, dimensions with unknown members, facts with keys as of their time, and their tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.history import with_unknown
from millrace.operators.joins import broadcast_if_small, version_join
from millrace.operators.series import calendar


def dim_date(spark: SparkSession, first: str = "2024-01-01", last: str = "2025-12-31") -> DataFrame:
    d = F.col("day")
    iso = F.extract(F.lit("dayofweek_iso"), d).cast("int")
    return calendar(spark, first, last).select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d.alias("date"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.date_format(d, "EEEE").alias("day_name"), iso.alias("iso_day"), (iso >= 6).alias("is_weekend"),
    )


def dim_scd1(rows: DataFrame, key: str, unknown: dict[str, object]) -> DataFrame:
    """A dimension that keeps the newest state, with a surrogate key and the unknown member."""
    dim = rows.withColumn("sk", F.md5(F.col(key).cast("string")))
    return with_unknown(dim, unknown | {"sk": None}).withColumn("sk", F.coalesce("sk", F.md5(F.lit("unknown"))))


def fact_with_versions(facts: DataFrame, dim: DataFrame, key: str, time: str) -> DataFrame:
    """Facts with the surrogate key of the version valid at their time, or of the unknown member."""
    slim = dim.select(key, "valid_from", "valid_to", "sk")
    joined = version_join(facts, broadcast_if_small(slim), key, time)
    return joined.withColumn("sk", F.coalesce("sk", F.md5(F.lit("unknown")))).drop("valid_from", "valid_to")


# Tests give the rows that fail.
def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, amount_left: Column, amount_right: Column) -> DataFrame:
    """One row if counts or sums differ, none if they agree."""
    a = left.agg(F.count("*").alias("n_left"), F.coalesce(F.sum(amount_left), F.lit(0)).alias("sum_left"))
    b = right.agg(F.count("*").alias("n_right"), F.coalesce(F.sum(amount_right), F.lit(0)).alias("sum_right"))
    return a.crossJoin(b).where("n_left <> n_right OR sum_left <> sum_right")


def verdict(failing: int, warn_if: int = 1, error_if: int | None = None) -> str:
    """``pass``, ``warn`` or ``error`` from the number of failing rows."""
    if error_if is not None and failing >= error_if:
        return "error"
    return "warn" if failing >= warn_if else "pass"


def freshness(df: DataFrame, column: str, now: Column, warn_hours: float = 24, error_hours: float = 72) -> DataFrame:
    age = (now.cast("timestamp").cast("double") - F.max(F.col(column).cast("timestamp")).cast("double")) / 3600
    return df.agg(age.alias("age_hours")).withColumn("status", F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))


@dataclass
class Models:
    """A registry of models that name what they are built from: views, tables, and their lineage."""

    spark: SparkSession
    models: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = field(default_factory=dict)
    sources: dict[str, DataFrame] = field(default_factory=dict)

    def source(self, name: str, df: DataFrame) -> None:
        self.sources[name] = df
        df.createOrReplaceTempView(name)

    def model(self, name: str, *refs: str) -> Callable:
        def add(f: Callable[..., DataFrame]) -> Callable:
            self.models[name] = (refs, f)
            return f

        return add

    def order(self) -> list[str]:
        done: list[str] = []

        def visit(n: str, above: tuple[str, ...]) -> None:
            if n in above:
                raise ValueError(f"a circle of models: {' > '.join([*above, n])}")
            if n in self.sources or n in done:
                return
            if n not in self.models:
                raise KeyError(f"{n} is neither a model nor a source")
            for r in self.models[n][0]:
                visit(r, (*above, n))
            done.append(n)

        for n in self.models:
            visit(n, ())
        return done

    def build(self) -> dict[str, DataFrame]:
        built = dict(self.sources)
        for n in self.order():
            refs, f = self.models[n]
            built[n] = f(*[built[r] for r in refs])
            built[n].createOrReplaceTempView(n)
        return built

    def edges(self) -> DataFrame:
        rows = [(r, n) for n, (refs, _) in self.models.items() for r in refs]
        return self.spark.createDataFrame(rows, "upstream string, downstream string")


def impact(edges: DataFrame, start: str) -> DataFrame:
    """Everything downstream of a node, with its least distance."""
    edges.createOrReplaceTempView("__edges")
    return edges.sparkSession.sql(
        f"WITH RECURSIVE d(node, depth) AS (SELECT '{start}', 0 UNION ALL SELECT e.downstream, d.depth + 1 FROM __edges e JOIN d ON e.upstream = d.node AND d.depth < 50) SELECT node, min(depth) AS depth FROM d WHERE depth > 0 GROUP BY node"
    )
