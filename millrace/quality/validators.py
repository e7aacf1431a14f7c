"""Record validators: ordered rules over text columns, the first that fails gives the reason.

Each returns the normalised columns and ``reason`` (null for a valid row), so valid and rejected rows
together are always the rows read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import day, empty_to_null, first_reason, instant

# Domains of the fields.
STATES = ["AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO"]
STATUSES = ["created", "paid", "shipped", "canceled"]
LAKE_STATUSES = ["created", "paid", "shipped", "delivered", "canceled"]
LAKE_FIELDS = ["order_id", "customer_id", "country", "category", "amount", "status", "order_date", "updated_at"]
EVENT_FIELDS = ["order_id", "seq", "customer_id", "status", "amount", "event_ts"]


def _amount(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("decimal(38,18)")


def _cents(c: Column) -> Column:
    return F.bround(c, 2).cast("decimal(12,2)")


def etl_orders(df: DataFrame) -> DataFrame:
    """Orders of a CSV extract: states and statuses in any case, comma or dot, a missing ``updated_at`` is ``created_at``."""
    v = {c: empty_to_null(F.col(c)) for c in ("order_id", "customer_id", "amount", "status", "uf", "created_at", "updated_at")}
    amount, status, uf = _amount(v["amount"]), F.lower(v["status"]), F.upper(v["uf"])
    created, updated = instant(v["created_at"]), F.when(v["updated_at"].isNull(), instant(v["created_at"])).otherwise(instant(v["updated_at"]))
    reason = first_reason([
        (v["order_id"].isNull(), "missing order_id"), (v["customer_id"].isNull(), "missing customer_id"), (v["amount"].isNull(), "missing amount"),
        (amount.isNull(), "invalid amount"), (amount < 0, "negative amount"), (v["status"].isNull(), "missing status"), (~status.isin(STATUSES), "unknown status"),
        (uf.isNotNull() & ~uf.isin(STATES), "unknown uf"), (created.isNull(), "invalid created_at"), (updated.isNull(), "invalid updated_at"), (updated < created, "updated before created"),
    ])
    return df.select("*", F.struct(v["order_id"].alias("order_id"), v["customer_id"].alias("customer_id"), _cents(amount).alias("amount"), status.alias("status"), uf.alias("uf"), created.alias("created_at"), updated.alias("updated_at")).alias("clean"), reason.alias("reason"))


def daily_orders(df: DataFrame, ds: str) -> DataFrame:
    """Orders of one partition day; statuses are case-sensitive, the date must be the partition's."""
    amount = F.col("amount").try_cast("decimal(38,18)")
    reason = first_reason([
        (F.coalesce(F.col("order_id"), F.lit("")) == "", "missing order_id"), (F.trim(F.coalesce(F.col("customer_id"), F.lit(""))) == "", "missing customer_id"),
        (amount.isNull() | (amount < 0), "bad amount"), (~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "unknown status"), (~F.col("order_date").eqNullSafe(F.lit(ds)), "wrong partition"),
    ])
    return df.withColumn("reason", reason)


def json_fields(value: Column, names: list[str]) -> Column:
    """A struct of text fields of a JSON object; null if the text isn't one."""
    record = F.from_json(value, ", ".join(f"`{n}` string" for n in [*names, "_corrupt"]), {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    is_object = F.trim(value).startswith("{") & F.trim(value).endswith("}")
    return F.when(is_object & record["_corrupt"].isNull(), record)


def lake_orders(df: DataFrame, value: str = "value", fold: bool = False) -> DataFrame:
    """Order lines in JSON. ``fold``: negative amounts and bad timestamps have no reasons of their own."""
    out = df.withColumn("__r", json_fields(F.col(value), LAKE_FIELDS))
    f = {n: empty_to_null(F.col(f"__r.{n}")) for n in LAKE_FIELDS}
    amount, date, at, status = f["amount"].try_cast("decimal(38,18)"), day(f["order_date"]), instant(f["updated_at"]), f["status"]
    missing = F.coalesce(*[F.when(f[n].isNull(), F.lit(f"missing_field:{n}")) for n in LAKE_FIELDS])
    reason = first_reason([
        (F.col("__r").isNull(), "invalid_json"), (missing.isNotNull(), missing), (amount.isNull(), "bad_amount"), (amount < 0, "bad_amount" if fold else "negative_amount"),
        (date.isNull(), "bad_date"), (at.isNull(), "bad_date" if fold else "bad_timestamp"), (~status.isin(LAKE_STATUSES), "unknown_status"),
    ])
    clean = F.struct(*[f[n].alias(n) for n in ("order_id", "customer_id", "country", "category")], _cents(amount).alias("amount"), status.alias("status"), date.alias("order_date"), at.alias("updated_at"))
    return out.select(*df.columns, clean.alias("clean"), reason.alias("reason"))


def order_events(df: DataFrame, value: str = "value", statuses: list[str] | None = None) -> DataFrame:
    """Messages of a log of order events."""
    out = df.withColumn("__r", json_fields(F.col(value), [*EVENT_FIELDS, "schema_version"]))
    f = {n: F.col(f"__r.{n}") for n in [*EVENT_FIELDS, "schema_version"]}
    seq, amount, at = f["seq"].try_cast("int"), f["amount"].try_cast("decimal(38,18)"), instant(f["event_ts"])
    missing = F.coalesce(*[F.when(F.coalesce(f[n], F.lit("")) == "", F.lit(f"missing_field:{n}")) for n in EVENT_FIELDS])
    reason = first_reason([
        (F.trim(F.coalesce(F.col(value), F.lit(""))) == "", "empty_payload"), (F.col("__r").isNull(), "invalid_json"),
        (~f["schema_version"].eqNullSafe(F.lit("1")), F.concat(F.lit("unsupported_schema_version:"), F.coalesce(f["schema_version"], F.lit("None")))),
        (missing.isNotNull(), missing), (seq.isNull() | (seq < 1) | ~f["seq"].rlike(r"^-?\d+$"), "bad_seq"), (~f["status"].isin(statuses or LAKE_STATUSES), "unknown_status"),
        (amount.isNull() | (amount < 0), "bad_amount"), (at.isNull(), "bad_timestamp"),
    ])
    clean = F.struct(F.concat_ws("-", f["order_id"], seq).alias("event_id"), f["order_id"].alias("order_id"), seq.alias("seq"), f["customer_id"].alias("customer_id"), f["status"].alias("status"), _cents(amount).alias("amount"), at.alias("event_ts"))
    return out.select(*df.columns, clean.alias("clean"), reason.alias("reason"))


def object_rows(df: DataFrame) -> DataFrame:
    """Rows of a CSV object: the first blank field, then amount, date and status."""
    names = ["order_id", "customer_id", "amount", "status", "order_date"]
    f = {n: empty_to_null(F.col(n)) for n in names}
    missing = F.coalesce(*[F.when(f[n].isNull(), F.lit(f"missing_field:{n}")) for n in names])
    amount, status = _amount(f["amount"]), F.lower(f["status"])
    reason = first_reason([(missing.isNotNull(), missing), (amount.isNull() | (amount < 0), "bad_amount"), (day(f["order_date"]).isNull(), "bad_date"), (~status.isin(STATUSES + ["delivered"]), "unknown_status")])
    clean = F.struct(f["order_id"].alias("order_id"), f["customer_id"].alias("customer_id"), _cents(amount).cast("string").alias("amount"), status.alias("status"), f["order_date"].alias("order_date"))
    return df.select("*", clean.alias("clean"), reason.alias("reason"))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, normalised, and rejected ones as they came, with their reason."""
    valid = checked.where("reason IS NULL")
    return (valid.select("clean.*") if "clean" in checked.columns else valid.drop("reason")), checked.where("reason IS NOT NULL").drop("clean")
