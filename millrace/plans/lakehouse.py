"""Daily pipelines: bronze, gate, silver, gold; every step can run again with the same result."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lake import LakeTable
from millrace.operators.dedupe import latest
from millrace.quality.engine import batch_gate
from millrace.quality.validators import lake_orders, split
from millrace.sources import store
from millrace.sources.files import json_lines


def store_bronze(folder: str, ds: str, content: bytes) -> tuple[str, bool]:
    """An immutable file named by its content, on any store; storing the same bytes again does nothing."""
    spark = SparkSession.active()
    path = f"{folder}/ingest_date={ds}/batch-{hashlib.sha256(content).hexdigest()[:12]}.jsonl"
    if store.exists(spark, path):
        return path, False
    try:
        store.write_bytes(spark, path, content)
    except FileExistsError:  # another writer stored the same bytes meanwhile
        return path, False
    return path, True


def silver_from_bronze(spark: SparkSession, bronze: str) -> tuple[DataFrame, DataFrame]:
    """All bronze lines to the newest valid state of each order, and the rejected lines with their reason."""
    lines = json_lines(spark, f"{bronze}/*/*.jsonl")
    lines = lines.withColumn("ingest_date", F.regexp_extract("source_file", r"ingest_date=(\d{4}-\d{2}-\d{2})", 1))
    checked = lake_orders(lines, "raw")
    valid = checked.where("reason IS NULL").select("clean.*", "ingest_date", F.col("source_file").alias("_source_file"), "line_no")
    order = [F.col(c).desc() for c in ("updated_at", "ingest_date", "_source_file", "line_no")]
    silver = latest(valid, ["order_id"], order).drop("ingest_date", "line_no")
    rejected = checked.where("reason IS NOT NULL").select(F.col("ingest_date").cast("date").alias("ingest_date"), "source_file", "line_no", "reason", "raw")
    return silver, rejected


def daily_revenue(silver: DataFrame) -> DataFrame:
    kept = silver.where("status <> 'canceled'")
    return kept.groupBy("order_date", "country", "category").agg(F.count("*").alias("orders"), F.sum("amount").cast("decimal(18,2)").alias("revenue"), F.avg("amount").cast("decimal(12,2)").alias("avg_ticket"))


def customer_value(silver: DataFrame) -> DataFrame:
    kept = silver.where("status <> 'canceled'")
    return kept.groupBy("customer_id").agg(F.count("*").alias("orders"), F.sum("amount").cast("decimal(18,2)").alias("lifetime_value"), F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"))


def status_funnel(silver: DataFrame, by_day: bool = True) -> DataFrame:
    return silver.groupBy(*(["order_date"] if by_day else []), "status").agg(F.count("*").alias("orders"))


GOLD = {"daily_revenue": daily_revenue, "customer_value": customer_value, "status_funnel": status_funnel}


@dataclass
class Day:
    status: str
    gate: dict
    read: int
    rejected: int

    @property
    def exit_code(self) -> int:
        return 0 if self.status == "success" else 2


class Lakehouse:
    """Bronze files, versioned silver, rejects and gold tables, and each day's gate, below one path.

    A day's gate is a small file: whether it was approved, its volume, and whether the day was published.
    It outlives the process; only published days are the baseline that later volumes are judged by.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.silver = LakeTable(spark, f"{path}/silver", ("order_date",))
        self.rejects = LakeTable(spark, f"{path}/rejects", ("ds",))
        self.gold = {n: LakeTable(spark, f"{path}/gold/{n}") for n in GOLD}

    def gate(self, ds: str) -> dict:
        """What the gate said of a day; not approved if it was not asked."""
        path = f"{self.path}/_gate/{ds}.json"
        return json.loads(store.read_text(self.spark, path)) if store.exists(self.spark, path) else {"ds": ds, "approved": False, "published": False}

    def _note(self, ds: str, **facts) -> None:
        store.write_text(self.spark, f"{self.path}/_gate/{ds}.json", json.dumps(self.gate(ds) | facts), replace=True)

    def volumes(self, before: str) -> list[int]:
        """The rows of the published days before a day, in order."""
        days = sorted(f.name[:-5] for f in store.listing(self.spark, f"{self.path}/_gate") if f.name.endswith(".json"))
        return [g["rows"] for g in map(self.gate, (d for d in days if d < before)) if g["published"]]

    def _lines(self, ds: str) -> DataFrame:
        return lake_orders(json_lines(self.spark, f"{self.path}/bronze/ingest_date={ds}/*.jsonl", count_blank=False), "raw", fold=True)

    def ingest(self, ds: str, content: bytes) -> bool:
        return store_bronze(f"{self.path}/bronze", ds, content)[1]

    def check(self, ds: str) -> tuple[dict, int, int]:
        """One aggregation over a day's lines answers the gate."""
        end = F.lit(ds).cast("timestamp") + F.expr("INTERVAL 1 DAY")
        good = F.col("reason").isNull()
        a = self._lines(ds).agg(
            F.count("*").alias("n"), F.count(F.when(~good, 1)).alias("rejected"),
            (F.count(F.when(good, 1)) - F.countDistinct(F.when(good, F.col("clean.order_id")))).alias("duplicates"),
            ((end.cast("double") - F.max(F.when(good, F.col("clean.updated_at"))).cast("double")) / 3600).alias("age"),
        ).first()
        gate = batch_gate(a["n"], a["rejected"], a["duplicates"], a["age"], self.volumes(ds))
        self._note(ds, approved=gate["approved"], rows=a["n"])
        return gate, a["n"], a["rejected"]

    def load_silver(self, ds: str) -> None:
        """Merge a day's valid rows; an order's state never goes back. Needs an approved gate."""
        if not self.gate(ds)["approved"]:
            raise PermissionError(f"the gate has not approved {ds}")
        checked = self._lines(ds)
        batch = checked.where("reason IS NULL").select("clean.*", F.lit(ds).alias("_ingest_ds"), "line_no")
        batch = latest(batch, ["order_id"], [F.col("updated_at").desc(), F.col("line_no").desc()]).drop("line_no")
        self.silver.merge(batch, ["order_id"], "updated_at", strict=True)
        lost = split(checked)[1].select(F.lit(ds).alias("ds"), "source_file", "line_no", "reason", "raw")
        self.rejects.overwrite_partitions(lost)

    def build_gold(self) -> None:
        for name, f in GOLD.items():
            self.gold[name].publish(f(self.silver.read()))

    def run_day(self, ds: str, content: bytes) -> Day:
        """Ingest, gate, silver, gold; a blocked day leaves silver and gold alone and exits with 2."""
        self.ingest(ds, content)
        gate, read, rejected = self.check(ds)
        if not gate["approved"]:
            return Day("blocked", gate, read, rejected)
        self.load_silver(ds)
        self.build_gold()
        self._note(ds, published=True)
        return Day("success", gate, read, rejected)

    def backfill(self, days: dict[str, bytes]) -> list[Day]:
        return [self.run_day(ds, days[ds]) for ds in sorted(days)]


def days_between(first: str, last: str) -> list[str]:
    a, b = datetime.fromisoformat(first), datetime.fromisoformat(last)
    return [(a + timedelta(days=i)).strftime("%Y-%m-%d") for i in range((b - a).days + 1)]
