"""Sinks: layouts, idempotent writes, quarantine, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def by_partition(df: DataFrame, path: str, columns: list[str], files_per_partition: int | str | None = "by size", codec: str = "zstd") -> None:
    """Hive-partitioned Parquet. Rows are dealt out by the partition columns first, so that a partition has few files, not one from each task.

    ``"by size"`` rebalances: a small partition is one task's, a large one is split into tasks of the
    advisory size. A number spreads each over as many tasks; ``None`` leaves the rows where they are.
    """
    if files_per_partition == "by size":
        df = df.hint("rebalance", *columns)
    elif files_per_partition:
        salt = [F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))] if files_per_partition > 1 else []
        df = df.repartition(*columns, *salt)
    df.write.mode("overwrite").option("compression", codec).partitionBy(*columns).parquet(path)


def replace_partitions(df: DataFrame, path: str, columns: list[str]) -> None:
    """Overwrites only the partitions that ``df`` has rows of; running again gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def in_batches(df: DataFrame, size: int, send: Callable[[list[Row]], None]) -> None:
    """Hands the rows of each partition to ``send`` in lists of at most ``size``, where they are. A task that runs again sends again, so ``send`` must not mind."""

    def run(rows: Iterator[Row]) -> None:
        for batch in batched(rows, size):
            send(list(batch))

    df.foreachPartition(run)


def with_files(df: DataFrame, files: int) -> DataFrame:
    """Fewer files without a shuffle, more with one."""
    return df.coalesce(files) if files < df.rdd.getNumPartitions() else df.repartition(files)


def quarantine_new(rejected: DataFrame, known: DataFrame | None, reason: str = "reason") -> DataFrame:
    """Rejected rows as JSON with a hash of row and reason; those already known are left out."""
    raw = F.to_json(F.struct(*[c for c in rejected.columns if c != reason]))
    out = rejected.select(F.md5(F.concat_ws("|", raw, F.col(reason))).alias("reject_hash"), raw.alias("raw"), F.col(reason).alias("reason")).distinct()
    return out if known is None else out.join(known.select("reject_hash"), "reject_hash", "left_anti")


def dead_letters(rejected: DataFrame, value: str, source: str) -> DataFrame:
    """Messages for a dead-letter log: the payload as it came, with its error and its source."""
    return rejected.select(F.col(value).alias("value"), F.col("reason").alias("error"), F.lit(source).alias("source"))


def json_by_day(df: DataFrame, path: str, day: str, tag: str) -> None:
    """JSON lines by day below a folder named by the input's tag, so the same input replaces its own output."""
    df.withColumn("dt", F.col(day)).write.mode("overwrite").partitionBy("dt").json(f"{path}/source={tag}")


def bucketed(df: DataFrame, table: str, buckets: int, key: str, path: str | None = None) -> None:
    """A table whose joins and aggregations on the key need no shuffle; its files lie at ``path``, or in the warehouse."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def materialised_view(spark: SparkSession, query: str, path: str) -> DataFrame:
    """The rows of a query, written; calling it again refreshes them."""
    spark.sql(query).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
