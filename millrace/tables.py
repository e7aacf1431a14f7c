"""Loading tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, folder: str, name: str, *, instants: bool = False) -> DataFrame:
    """``folder/name.parquet``. ``instants``: TIMESTAMP_NTZ columns become UTC instants, as event-time operators need."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if not instants:
        return df
    local = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local})
