"""The thin queries over the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, licenses, line_dedup, mixture, pii, pipeline, quality_gam, quality_rules, simhash, token_orc, warc


def _over(report: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: report(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_gam": _over(quality_gam.report, "documents", "labels"),
    "op2_simhash_near_dedup": _over(simhash.report, "documents"),
    "op3_pii": _over(pii.report, "documents"),
    "op4_decontaminate": _over(decontaminate.report, "documents", "benchmark"),
    "op5_licenses": _over(licenses.report, "documents"),
    "op6_mixture": _over(mixture.report, "documents"),
    "op7_line_dedup": _over(line_dedup.report, "documents"),
    "op8_warc": _over(warc.report, "pages"),
    "op9_token_orc": _over(token_orc.report, "documents"),
    "op10_quality_rules": _over(quality_rules.report, "documents"),
    "pipeline": pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_licenses": licenses.oracle(),
    "op6_mixture": mixture.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
}
