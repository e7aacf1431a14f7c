"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes ``(spark, docs, folder)`` and returns a DataFrame; :func:`run` writes each result as
Parquet below the shared folder and reads it again as the next stage's documents.

1. ``quality_rules`` drops documents that the rules reject.
2. ``near_duplicates`` keeps one document of each group, the one with the least id.
3. ``decontaminate`` drops documents that hold a benchmark item.
4. ``mix_sources`` takes documents as often as the mix does; copies are rows of their own.
5. ``token_files`` writes token ids as ORC and returns the digest of what the files hold.

Stages judge rows, not ids: a row whose id is null or repeated is kept or dropped for its own text.
Null texts count as empty throughout (the first stage rejects empty ones), very long texts go through
whole, columns of any other names pass, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, mixture, quality_rules, simhash, token_orc
from millrace.llm.common import materialised


def _quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality_rules.keep(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.keep(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.keep(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def _mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixture.sample(docs)


def _token_files(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return token_orc.report(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _quality_rules),
    ("near_duplicates", _near_duplicates),
    ("decontaminate", _decontaminate),
    ("mix_sources", _mix_sources),
    ("token_files", _token_files),
]

#: Fingerprints, compression and tokens have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
