"""File sources: text-only CSV, JSON lines with their places, Hive partitions, objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class PermanentError(ValueError):
    """Input that no retry will make good."""


def csv_text(spark: SparkSession, path: str, multi_line: bool = True, **options: str) -> DataFrame:
    """CSV with a header, all columns text; a byte order mark is skipped. Quoted fields may hold line breaks with ``multi_line``, which reads a file in one task; without it large files are split."""
    return spark.read.options(header="true", inferSchema="false", multiLine=str(multi_line).lower(), quote='"', escape='"', **options).csv(path)


def csv_indexed(spark: SparkSession, path: str) -> DataFrame:
    """All-text CSV with ``_rn``, the row's place: files by name, then rows. Within a file the reader keeps its order; no sort of all rows in one task."""
    df = csv_text(spark, path).withColumn("__id", F.monotonically_increasing_id())
    return df.withColumnRenamed("__id", "_rn")


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def json_lines(spark: SparkSession, path: str, count_blank: bool = True) -> DataFrame:
    """``source_file, line_no, raw`` of the lines that aren't blank. ``count_blank``: numbers are of physical lines, else of those that aren't blank.

    Files are read in splits: lines are numbered within their split, and splits start where the counts of
    those before them in the file end. No file is one row, and no task holds one.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("raw"))
    if not count_blank:
        lines = lines.where("trim(raw) <> ''")
    before = Window.partitionBy("source_file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = lines.groupBy("source_file", "at").agg(F.count("*").alias("lines")).select("source_file", "at", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("source_file", "at").orderBy("n"))
    numbered = lines.withColumn("place", within).join(starts, ["source_file", "at"])
    return numbered.where("trim(raw) <> ''").select("source_file", (F.col("start") + F.col("place")).cast("int").alias("line_no"), "raw")


def between_days(spark: SparkSession, path: str, column: str, first: str, last: str) -> DataFrame:
    """A Hive-partitioned table's rows of an inclusive span of days; other folders are not listed as input."""
    return spark.read.parquet(path).where(F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def object_csv(spark: SparkSession, path: str, required: list[str], most_bytes: int = 50 << 20) -> DataFrame:
    """A delivered CSV object. Too large, not UTF-8, or without a required column is a :class:`PermanentError`."""
    found = spark.read.format("binaryFile").load(path).select("length").first()
    if found is None or found[0] > most_bytes:
        raise PermanentError(f"{path}: no object of at most {most_bytes} bytes")
    df = csv_text(spark, path, encoding="UTF-8")
    if missing := [c for c in required if c not in df.columns]:
        raise PermanentError(f"{path}: missing columns {missing}")
    if df.where(F.exists(F.array(*df.columns), lambda x: F.contains(x, F.lit("�")))).limit(1).count():
        raise PermanentError(f"{path}: not UTF-8")
    return df


def read_any(spark: SparkSession, path: str, kind: str, **options: str) -> DataFrame:
    """One reader for parquet, orc, json, csv, text, xml, jdbc and what else is on the class path."""
    return spark.read.format(kind).options(**options).load(path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, rows`` of Parquet files; rows are counted from footers, no column is read."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def ranked_lines(df: DataFrame) -> DataFrame:
    """Line numbers that run through a file's parts, when lines were read without ``wholetext``."""
    w = Window.partitionBy(F.col("_metadata.file_path")).orderBy(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.withColumn("line_no", F.row_number().over(w))
