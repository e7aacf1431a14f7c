"""Joins that Spark lacks or that need care at scale: as-of, versions by time, intervals, skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: each column's usual size, and texts by their length."""
    out = F.lit(8 + df._jdf.schema().defaultSize()).cast("long")
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    return out


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES, measured: int | None = None) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``most_bytes``; else ``df`` as it is, to be joined by shuffle.

    The optimizer's estimate follows compressed files and may be far too small. Where it is within the limit the rows are
    measured, by :func:`row_bytes` in a job of its own, unless the caller knows their sum.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most_bytes:
        return df
    if measured is None:
        measured = df.agg(F.sum(row_bytes(df))).first()[0]
    return F.broadcast(df) if (measured or 0) <= most_bytes else df


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], prefix: str = "", tie: str | None = None) -> DataFrame:
    """Each left row with the latest right row of the same keys whose time is not later; null where there is none.

    Both sides go through one exchange on ``by`` and one ordered window, so the work grows with the
    rows, not with pairs. ``tie`` orders right rows of equal time; the largest wins. Null keys find nothing.
    """
    values = F.struct(*[F.col(c).alias(f"v_{c}") for c in take])
    tie_of = F.col(tie) if tie else F.lit(0)
    kind = right.select(values.alias("v")).schema["v"].dataType
    tie_kind = right.select(tie_of.alias("t")).schema["t"].dataType
    row = F.struct(*[left[c] for c in left.columns]).alias("__row")
    l = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(tie_kind).alias("__tie"), F.lit(None).cast(kind).alias("__v"), row)
    r = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), tie_of.alias("__tie"), values.alias("__v"))
    r = r.where(" AND ".join(f"__k{i} IS NOT NULL" for i in range(len(by))))
    both = l.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    return out.select("__row.*", *[F.col(f"__last.v_{c}").alias(prefix + c) for c in take])


def version_join(facts: DataFrame, dim: DataFrame, key: str, time: str, valid_from: str = "valid_from", valid_to: str = "valid_to", how: str = "left") -> DataFrame:
    """Each fact with the dimension's version valid at its time: ``valid_from <= time < valid_to``. Equal keys are hashed, the interval is a residual predicate."""
    d = dim.withColumnRenamed(key, "__key")
    on = (facts[key] == d["__key"]) & (facts[time] >= d[valid_from]) & (facts[time] < d[valid_to])
    return facts.join(d, on, how).drop("__key")


def overlaps(df: DataFrame, key: str, start: str, end: str, id: str) -> DataFrame:
    """Pairs ``a < b`` of rows of a key whose intervals ``[start, end)`` overlap.

    In the order of their starts, those that start within an interval follow it without a gap, up to the
    number of starts before its end. That number comes from one ordered window over starts and ends, and the
    pairs from a join on places, so the work grows with rows and results, not with a key's pairs. An id
    stands once in its key; null keys meet nothing.
    """
    rows = df.select(F.col(key).alias("key"), F.col(id).alias("id"), F.col(start).alias("from"), F.col(end).alias("to")).where("key IS NOT NULL")
    starts = rows.select("*", F.col("from").alias("t"), F.lit(1).alias("starts"))
    both = starts.unionByName(rows.select("*", F.col("to").alias("t"), F.lit(0).alias("starts")))
    order = Window.partitionBy("key").orderBy("t", "starts", "id").rowsBetween(Window.unboundedPreceding, 0)  # an end comes before the starts at its time
    counted = both.withColumn("n", F.sum("starts").over(order))
    left = counted.where("starts = 1").select("key", "id", "from", "to", F.col("n").alias("place"))
    last = counted.where("starts = 0").select("key", F.col("id").alias("of"), F.col("n").alias("last"))
    spans = left.join(last, (left["key"] == last["key"]) & (left["id"] == last["of"])).where("last > place").select(left["key"], left["id"].alias("x"), left["from"].alias("x_from"), left["to"].alias("x_to"), F.explode(F.sequence(F.col("place") + 1, "last")).alias("place"))
    found = spans.join(left, ["key", "place"]).where("x <> id AND x_from < to AND from < x_to")
    return found.select("key", F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))


def hot_keys(df: DataFrame, key: str, min_share: float = 0.05, sample: float | None = None) -> DataFrame:
    """``key``, ``share`` of the keys that hold at least ``min_share`` of the rows: at most ``1 / min_share`` rows. ``sample`` counts a share of the rows only."""
    counted = (df.sample(sample, 7) if sample else df).groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).where(F.col("n") >= min_share * F.col("total")).select(key, (F.col("n") / F.col("total")).alias("share"))


def salted_join(facts: DataFrame, dim: DataFrame, key: str, hot: list, salts: int = 16, how: str = "left", salt_by: Column | None = None) -> DataFrame:
    """A join whose hot keys are spread: facts get a salt from a hash of their content, so retries agree, and hot dimension rows stand once for each salt."""
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    spread = F.pmod(F.xxhash64(salt_by if salt_by is not None else F.struct(*[c for c in facts.columns])), F.lit(salts))
    left = facts.withColumn("__salt", F.when(is_hot, spread).otherwise(0).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(dim.withColumn("__salt", F.explode(copies)), [key, "__salt"], how).drop("__salt")


def null_safe_split_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join in which rows without a key skip the shuffle: they cannot match."""
    matched = left.where(F.col(key).isNotNull()).join(right, key, "left")
    return matched.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
