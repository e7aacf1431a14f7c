"""Windowed counts over a click stream: parse, reject, deduplicate, aggregate, and sinks that apply a batch once."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.quality.validators import json_fields

FIELDS = ["event_id", "user_id", "page", "event_time"]
WATERMARK = "120 seconds"
WINDOW = "60 seconds"


def replay_source(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A log of ``partition, offset, value`` kept as JSON files, read as a stream: one file is one micro-batch."""
    return spark.readStream.schema("`partition` int, `offset` long, value string").option("maxFilesPerTrigger", files_per_batch).json(folder)


def topic_options(servers: str, topic: str, start: str = "earliest", rows_per_batch: int | None = None) -> dict[str, str]:
    """What the connector is told: where the topic is, where to begin, and how much a micro-batch may take. Log ends that retention cut off are no error."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "failOnDataLoss": "false"}
    return options | ({"maxOffsetsPerTrigger": str(rows_per_batch)} if rows_per_batch else {})


def kafka_source(spark: SparkSession, servers: str, topic: str, **more) -> DataFrame:
    """A topic as ``partition, offset, value``; needs the Kafka connector on the class path. ``more``: see :func:`topic_options`."""
    log = spark.readStream.format("kafka").options(**topic_options(servers, topic, **more)).load()
    return log.selectExpr("`partition`", "`offset`", "string(value) AS value")


def parse(raw: DataFrame, value: str = "value") -> DataFrame:
    """Typed fields, ``bad_json`` and ``valid``: three texts that aren't empty and a time that parses."""
    out = raw.withColumn("__r", json_fields(F.col(value), FIELDS))
    out = out.withColumn("bad_json", F.col("__r").isNull()).select("*", *[F.col(f"__r.{n}").alias(n) for n in FIELDS[:3]], F.try_to_timestamp("__r.event_time").alias("event_time"))
    texts = [F.coalesce(F.trim(n), F.lit("")) != "" for n in FIELDS[:3]]
    return out.withColumn("valid", ~F.col("bad_json") & texts[0] & texts[1] & texts[2] & F.col("event_time").isNotNull()).drop("__r")


def rejects(parsed: DataFrame, value: str = "value") -> DataFrame:
    return parsed.where("NOT valid").select(F.col(value).alias("raw"), F.when(F.col("bad_json"), "invalid_json").otherwise("missing_or_bad_field").alias("reason"))


def windowed_counts(parsed: DataFrame, watermark: str = WATERMARK, window: str = WINDOW) -> DataFrame:
    """``window_start, page, views, users``: an event id counts once, in a stream as long as the watermark remembers it.

    Users are never gathered. A table counts them in two levels, by user and then by page, so a hot page
    is spread over its users. A stream, which keeps one aggregation's state, holds a sketch for each window
    and page: exact for some hundreds of users, then within 1.6 % (standard error).
    """
    valid = parsed.where("valid")
    if not valid.isStreaming:
        once = valid.groupBy("event_id").agg(F.min(F.struct("event_time", "page", "user_id")).alias("e")).select("e.*")
        each = once.groupBy(F.window("event_time", window).alias("w"), "page", "user_id").agg(F.count("*").alias("n"))
        counts = each.groupBy("w", "page").agg(F.sum("n").alias("views"), F.count("user_id").cast("int").alias("users"))
    else:
        once = valid.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["event_id"])
        users = F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).cast("int")
        counts = once.groupBy(F.window("event_time", window).alias("w"), "page").agg(F.count("*").alias("views"), users.alias("users"))
    return counts.select(F.col("w.start").alias("window_start"), "page", "views", "users")


def session_counts(parsed: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    return parsed.where("valid").withWatermark("event_time", watermark).groupBy(F.session_window("event_time", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def sliding_counts(parsed: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    return parsed.where("valid").withWatermark("event_time", watermark).groupBy(F.window("event_time", window, slide), "page").agg(F.count("*").alias("views")).select(F.col("window.start").alias("window_start"), "page", "views")


def running_totals(parsed: DataFrame) -> DataFrame:
    """The global window: totals so far, for complete mode."""
    return parsed.where("valid").groupBy().agg(F.count("*").alias("views"), F.approx_count_distinct("user_id").alias("users"))


def enriched(parsed: DataFrame, users: DataFrame) -> DataFrame:
    """Stream with static: the small side is read anew for each batch."""
    return parsed.where("valid").join(users, "user_id", "left")


def matched_within(left: DataFrame, right: DataFrame, key: str, minutes: int = 10, watermark: str = WATERMARK) -> DataFrame:
    """Stream with stream: right events of the same key up to some minutes after the left ones; both sides' state is bounded by watermarks."""
    l = left.withWatermark("event_time", watermark).select(F.col(key).alias("key"), F.col("event_id").alias("left_id"), F.col("event_time").alias("left_time"))
    r = right.withWatermark("event_time", watermark).select(F.col(key).alias("r_key"), F.col("event_id").alias("right_id"), F.col("event_time").alias("right_time"))
    return l.join(r, F.expr(f"key = r_key AND right_time >= left_time AND right_time <= left_time + INTERVAL {minutes} MINUTES"), "leftOuter").drop("r_key")


class LedgerSink:
    """``foreachBatch`` into a lake table: a batch's data and its number are committed as one version, so a replayed batch changes nothing.

    Only the files that hold a key of the batch are read and rewritten; ``combine`` sees their rows, so its
    result for a key must depend on that key's rows alone. Without keys it sees the whole table. With
    ``append`` the batch's rows are added, and no file is read.
    """

    def __init__(self, table, keys: list[str], query: str, combine: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None, append: bool = False):
        self.table, self.keys, self.query, self.combine, self.append = table, keys, query, combine, append

    def applied(self) -> int:
        m = self.table.manifest()
        return -1 if m is None else m.get("ledger", {}).get(self.query, -1)

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.applied():
            return
        m = self.table.manifest()
        ledger = {**(m or {}).get("ledger", {}), self.query: number}
        if m is None or self.append or not self.keys:
            new = batch if self.append or not self.combine else self.combine(None if m is None else self.table.read(), batch)
            before = m["files"] if m and self.append else []
            self.table._commit(before + self.table._put(new), new.schema, "batch", m["version"] if m else None, ledger=ledger)
            return
        # without a rule, values are absolute: the batch's rows replace those of their keys
        replace = lambda old, new: old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)
        self.table.update(batch, self.keys, self.combine or replace, "batch", ledger=ledger)


def advance_only(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State by key that only moves forward in ``seq``, and takes an event once."""
    both = batch if current is None else current.unionByName(batch.select(*current.columns))
    rest = [c for c in both.columns if c != "order_id"]
    return both.groupBy("order_id").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("order_id", "s.*").select(*both.columns)


def run_available(df: DataFrame, sink: Callable, checkpoint: str, mode: str = "update"):
    """Process what is there, then stop; the finished query, for its progress."""
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress(query) -> dict:
    """Rows read, rows dropped as late by any stateful operator, and the watermarks seen."""
    seen = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    return {
        "rows": sum(p["numInputRows"] for p in seen),
        "dropped_late": sum(o.get("numRowsDroppedByWatermark", 0) for p in seen for o in p["stateOperators"]),
        "watermarks": sorted({p["eventTime"]["watermark"] for p in seen if "watermark" in p.get("eventTime", {})}),
    }


def lag(query) -> dict[str, int]:
    """Rows behind, by source, where the source tells its newest offset."""
    p = query.lastProgress
    return {s["description"]: int((s.get("metrics") or {}).get("avgOffsetsBehindLatest", 0) or 0) for s in (json.loads(p.json) if hasattr(p, "json") else p)["sources"]} if p else {}


def expected_counts(batches: list[list[dict]], delay_s: int = 120, window_s: int = 60) -> dict:
    """The stated semantics over batches of valid events, row by row: the independent check of the streaming job.

    The watermark of a batch is the latest time of earlier batches less the delay. An event goes if its
    id was seen, if its time is not after the watermark (deduplication comes first and drops by time), or
    if its window has ended by the watermark.
    """
    seen: set[str] = set()
    out, users = {}, {}
    latest, dup, late = None, 0, 0
    for batch in batches:
        mark = latest - timedelta(seconds=delay_s) if latest else None
        for e in batch:
            t: datetime = e["event_time"]
            start = datetime.fromtimestamp(int(t.timestamp()) // window_s * window_s, t.tzinfo)
            if mark and (t <= mark or start + timedelta(seconds=window_s) <= mark):
                late += 1
            elif e["event_id"] in seen:
                dup += 1
            else:
                seen.add(e["event_id"])
                out[start, e["page"]] = out.get((start, e["page"]), 0) + 1
                users.setdefault((start, e["page"]), set()).add(e["user_id"])
        latest = max([latest] * bool(latest) + [e["event_time"] for e in batch], default=latest)
    return {"windows": {k: (v, len(users[k])) for k, v in out.items()}, "duplicates": dup, "late": late}


def topic_lag(log: DataFrame, committed: DataFrame) -> DataFrame:
    """``partition, size, lag``: rows a log holds and rows past the committed offset; a partition never committed lags by all of it."""
    ends = log.groupBy("partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))
    joined = ends.join(committed.select("partition", F.col("offset").alias("done")), "partition", "left")
    behind = F.col("high") - F.greatest(F.coalesce("done", F.lit(0)), F.lit(0))
    return joined.select("partition", (F.col("high") - F.col("low")).alias("size"), behind.alias("lag"))
