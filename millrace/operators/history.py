"""Slowly changing dimensions, change data capture and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.dedupe import latest, merge_newer

FIRST, OPEN = "1900-01-01 00:00:00", "9999-12-31 00:00:00"


def scd2_from_versions(versions: DataFrame, key: str, time: str) -> DataFrame:
    """All versions of each key with ``valid_from`` (the first reaches back to 1900), ``valid_to``, ``version_no``, ``is_current`` and a surrogate key."""
    w = Window.partitionBy(key).orderBy(time)
    nxt = F.lead(time).over(w)
    no = F.row_number().over(w)
    out = versions.withColumn("version_no", no.cast("long")).withColumn("valid_to", F.coalesce(nxt, F.lit(OPEN).cast(versions.schema[time].dataType)))
    out = out.withColumn("valid_from", F.when(F.col("version_no") == 1, F.lit(FIRST).cast(versions.schema[time].dataType)).otherwise(F.col(time)))
    return out.withColumn("is_current", nxt.isNull()).withColumn("sk", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.date_format(time, "yyyy-MM-dd HH:mm:ss"))))


def scd2_apply(dim: DataFrame, batch: DataFrame, key: str, time: str, compare: list[str] | None = None) -> DataFrame:
    """A snapshot step: a batch row opens a version if its time is newer (or, with ``compare``, if one of these columns differs), and closes the one before.

    ``dim`` has the batch's columns and ``valid_from``, ``valid_to`` (null while current). Closed versions pass through untouched.
    """
    closed, current = dim.where("valid_to IS NOT NULL"), dim.where("valid_to IS NULL")
    b = batch.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.struct(*batch.columns).alias("__new"))
    joined = current.join(b, current[key] == b["__key"], "full")
    if compare is None:
        changed = F.col("__time") > F.col(time)
    else:
        changed = F.lit(False)
        for c in compare:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"__new.{c}"))
    changed = F.col("__key").isNotNull() & (F.col(key).isNull() | F.coalesce(changed, F.lit(False)))
    joined = joined.withColumn("__changed", changed)
    old = joined.where(F.col(key).isNotNull()).withColumn("valid_to", F.when(F.col("__changed"), F.col("__time")))
    new = joined.where("__changed").select("__new.*", F.col("__time").alias("valid_from"), F.lit(None).cast(dim.schema["valid_to"].dataType).alias("valid_to"))
    return closed.unionByName(old.select(*dim.columns)).unionByName(new.select(*dim.columns))


def scd1_apply(dim: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Overwrite: batch rows replace those of their key."""
    return dim.join(batch.select(key), key, "left_anti").unionByName(batch)


def scd3_apply(dim: DataFrame, batch: DataFrame, key: str, column: str) -> DataFrame:
    """One column's previous value is kept beside it, in ``previous_<column>``."""
    b = batch.select(key, F.col(column).alias("__new"))
    out = dim.drop(f"previous_{column}").join(b, key, "left")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column))
    return out.withColumn(f"previous_{column}", F.when(changed, F.col(column))).withColumn(column, F.coalesce("__new", column)).drop("__new")


def with_unknown(dim: DataFrame, values: dict[str, object]) -> DataFrame:
    """A dimension and its unknown member."""
    schema = dim.schema
    row = dim.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])
    return dim.unionByName(row)


def cdc_unwrap(changes: DataFrame) -> DataFrame:
    """Rows of ``before, after, op, source`` to the flat new state, with ``op`` and ``lsn``; deletes carry the state before."""
    state = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    return changes.where("op IS NOT NULL").select(state.alias("s"), "op", F.col("source.lsn").alias("lsn")).select("s.*", "op", "lsn")


def cdc_apply(target: DataFrame, changes: DataFrame, key: str, soft_delete: bool = False) -> DataFrame:
    """The target after flat changes (``op`` c, u, r or d, ``lsn``): the last change of a key by ``lsn`` counts, however the changes arrive. ``target`` has ``lsn`` too."""
    last = latest(changes, [key], [F.col("lsn").desc()])
    both = target.withColumn("op", F.lit("r")).unionByName(last.select(*target.columns, "op"))
    out = latest(both, [key], [F.col("lsn").desc(), F.when(F.col("op") == "d", 0).otherwise(1).asc()])
    if soft_delete:
        return out.withColumn("is_deleted", F.col("op") == "d").drop("op")
    return out.where("op <> 'd'").drop("op")


def hub(df: DataFrame, business_key: str, source: str) -> DataFrame:
    """Data-vault hub: one row for each business key."""
    return df.select(F.md5(F.upper(F.trim(F.col(business_key).cast("string")))).alias("hub_key"), business_key, F.lit(source).alias("record_source")).distinct()


def satellite(df: DataFrame, business_key: str, columns: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Rows to insert: states whose ``hash_diff`` the satellite does not hold yet for their key."""
    diff = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    out = df.select(F.md5(F.upper(F.trim(F.col(business_key).cast("string")))).alias("hub_key"), diff.alias("hash_diff"), *columns).distinct()
    return out if existing is None else out.join(existing.select("hub_key", "hash_diff"), ["hub_key", "hash_diff"], "left_anti")


def increment(source: DataFrame, mark_column: str, mark, inclusive: bool = True) -> DataFrame:
    """Rows past a high-water mark; with ``inclusive`` the rows at the mark come again and are left to the keyed merge."""
    c = F.col(mark_column)
    return source if mark is None else source.where(c >= F.lit(mark) if inclusive else c > F.lit(mark))


def incremental_merge(target: DataFrame, source: DataFrame, keys: list[str], time: str, lookback_days: int = 3) -> DataFrame:
    """Rows of the last days before the target's newest are read again and merged by key."""
    mark = target.agg((F.max(time) - F.expr(f"INTERVAL {lookback_days} DAY")).alias("m")).first()[0]
    batch = latest(increment(source, time, mark), keys, [F.col(time).desc()])
    return merge_newer(target, batch, keys, time, strict=False)


def as_of_state(events: DataFrame, key: str, seq: str, state: Column) -> DataFrame:
    """Event-sourced projection: the state after a key's last event."""
    return events.groupBy(key).agg(F.max_by(state, seq).alias("state"), F.max(seq).alias("seq"))
