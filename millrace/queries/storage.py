"""Sources, sinks, lake tables and streams as round trips: what is read back must be what SQL finds in the tables."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from millrace.lake import LakeTable
from millrace.operators import dedupe
from millrace.queries.registry import Registry
from millrace.quality.validators import lake_orders
from millrace.sources import files, sinks
from millrace.streaming import clicks

Q = Registry()
_OWN: list[str] = []


def _scratch(spark) -> str:
    """A fresh path in the folder that executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="millrace-queries-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = f"file://{_OWN[0]}"
    path = f"{base.rstrip('/')}/millrace-queries/{uuid.uuid4().hex}"
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return path


_ORD = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
_COLS = ["o_orderkey", "o_custkey", "o_orderstatus"]


@Q("SRC-01", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"' || chr(10) || c_mktsegment AS label FROM customer")
def csv_quoted(spark, customer):
    path = _scratch(spark)
    customer.select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat("c_name", F.lit(', "\n'), "c_mktsegment").alias("label")).write.options(header="true", quote='"', escape='"').csv(path)
    return files.csv_text(spark, path)


@Q("SRC-02", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_nationkey AS BIGINT) AS _rn FROM nation")
def csv_indexed(spark, nation):
    path = _scratch(spark)
    nation.select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey").write.option("header", "true").csv(path)
    return files.csv_indexed(spark, path)


@Q("SRC-06", "SELECT CAST(event_id AS BIGINT) AS event_id, '{\"event_id\":' || event_id || '}' AS raw FROM events")
def lines(spark, events):
    path = _scratch(spark)
    events.select("event_id").repartition(3).write.json(path)
    out = files.json_lines(spark, f"{path}/*.json")
    return out.select(F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"), "raw")


@Q("SRC-08", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-01-20'")
def hive_range(spark, orders):
    path = _scratch(spark)
    sinks.by_partition(orders.select("o_orderkey", F.to_date("o_orderdate").alias("d")), path, ["d"])
    return files.between_days(spark, path, "d", "1996-01-01", "1996-01-20")


@Q("SRC-09", "SELECT c_custkey, c_acctbal FROM customer")
def csv_typed(spark, customer):
    path = _scratch(spark)
    customer.select("c_custkey", "c_acctbal").write.option("header", "true").csv(path)
    return files.csv_typed(spark, path, "c_custkey bigint, c_acctbal double")


def _round_trip(spark, orders, kind: str, codec: str):
    path = _scratch(spark)
    orders.select(*_COLS).write.format(kind).option("compression", codec).save(path)
    return files.read_any(spark, path, kind).select(*_COLS)


Q("SRC-21", _ORD)(lambda spark, orders: _round_trip(spark, orders, "orc", "zstd"))
Q("SRC-21b", _ORD)(lambda spark, orders: _round_trip(spark, orders, "json", "gzip"))
Q("SNK-08", _ORD)(lambda spark, orders: _round_trip(spark, orders, "parquet", "zstd"))


@Q("SRC-21c", "SELECT p_partkey, p_brand FROM part")
def xml(spark, part):
    path = _scratch(spark)
    part.select("p_partkey", "p_brand").write.format("xml").option("rowTag", "item").save(path)
    return spark.read.format("xml").option("rowTag", "item").schema("p_partkey bigint, p_brand string").load(path)


def _table(spark, *parts):
    return LakeTable(spark, _scratch(spark), parts)


@Q("SRC-10", f"{_ORD} WHERE o_orderstatus = 'F'")
def time_travel(spark, orders):
    t = _table(spark)
    t.overwrite(orders.select(*_COLS).where("o_orderstatus = 'F'"))
    t.append(orders.select(*_COLS).where("o_orderstatus <> 'F'"))
    return t.read(0)


@Q("SNK-02", "SELECT md5(raw || '|' || reason) AS reject_hash, raw, reason FROM (SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS raw, 'error' AS reason FROM events WHERE event_type = 'error' AND event_id % 2 = 1) t")
def quarantine(spark, events):
    bad = events.where("event_type = 'error'").select("event_id", "event_type", F.lit("error").alias("reason"))
    return sinks.quarantine_new(bad, sinks.quarantine_new(bad.where("event_id % 2 = 0"), None))


@Q("SNK-05", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS v, o_orderstatus FROM orders")
def partition_overwrite(spark, orders):
    path = _scratch(spark)
    rows = orders.select("o_orderkey", F.lit("old").alias("v"), "o_orderstatus")
    sinks.by_partition(rows, path, ["o_orderstatus"], 2)
    for _ in range(2):
        sinks.replace_partitions(rows.where("o_orderstatus = 'F'").withColumn("v", F.lit("new")), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "v", "o_orderstatus")


@Q("SNK-10", f"{_ORD}")
def publish(spark, orders):
    t = _table(spark)
    t.publish(orders.select(*_COLS))
    t.publish(orders.select(*_COLS).repartition(3))
    assert t.versions() == [0]
    return t.read()


@Q("SNK-14", _ORD)
def compact(spark, orders):
    t = _table(spark, "o_orderstatus")
    t.overwrite(orders.select(*_COLS).repartition(6))
    report = t.compact(1)
    assert report["after"] < report["before"]
    return t.read().select(*_COLS)


@Q("SNK-15", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN -1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders")
def replace_where(spark, orders):
    t = _table(spark, "o_orderstatus")
    t.overwrite(orders.select(*_COLS))
    t.overwrite_partitions(orders.select(*_COLS).where("o_orderstatus = 'O'").withColumn("o_custkey", F.lit(-1).cast("long")))
    return t.read().select(*_COLS)


@Q("SNK-16", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1")
def merge(spark, events):
    t = _table(spark)
    rows = events.select("user_id", "event_type", "event_id")
    for r in (2, 0, 1):  # batches come out of order
        t.merge(dedupe.latest_by_aggregate(rows.where(f"event_id % 3 = {r}"), ["user_id"], ["event_id"]), ["user_id"], "event_id")
    return t.read()


@Q("SNK-18", f"{_ORD} WHERE o_orderstatus = 'P'")
def restore(spark, orders):
    t = _table(spark)
    t.overwrite(orders.select(*_COLS).where("o_orderstatus = 'P'"))
    t.overwrite(orders.select(*_COLS))
    t.restore(0)
    t.vacuum(1, dry_run=False)
    return t.read()


@Q("SNK-23", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def json_days(spark, events):
    path = _scratch(spark)
    for _ in range(2):
        sinks.json_by_day(events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).coalesce(1), path, "day", "a1b2")
    return spark.read.schema("event_id bigint, day string").json(f"{path}/source=a1b2").select("event_id", "day")


@Q("SNK-25", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def view(spark, orders):
    orders.createOrReplaceTempView("orders")
    return sinks.materialised_view(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", _scratch(spark))


@Q("SNK-22", "SELECT '{\"order_id\":' || o_orderkey || '}' AS value, 'missing_field:customer_id' AS error, 'orders' AS source FROM orders")
def dead_letters(spark, orders):
    text = orders.select(F.concat(F.lit('{"order_id":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("value"))
    return sinks.dead_letters(lake_orders(text).where("reason IS NOT NULL"), "value", "orders")


def _click_files(spark, events, n: int = 3) -> str:
    """All events as a log of ``n`` files in time order, for a stream to replay."""
    path = _scratch(spark)
    value = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("page"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time")))
    rows = events.select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"), value.alias("value"), "ts")
    rows.repartitionByRange(n, "ts").sortWithinPartitions("ts").drop("ts").write.json(path)
    return path


@Q("STM-13", "SELECT time_bucket(INTERVAL 1 MINUTE, date_trunc('second', ts)) AS window_start, event_type AS page, CAST(count(*) AS BIGINT) AS views, CAST(count(DISTINCT user_id) AS INT) AS users FROM events GROUP BY 1, 2")
def streamed(spark, events):
    """The whole streaming job over a replayed log, into a ledger table; a second run on the same checkpoint changes nothing."""
    path, t, ck = _click_files(spark, events), _table(spark), _scratch(spark)
    for _ in range(2):
        counts = clicks.windowed_counts(clicks.parse(clicks.replay_source(spark, path, 100)), watermark="3650 days")
        clicks.run_available(counts, clicks.LedgerSink(t, ["window_start", "page"], "counts"), ck)
    return t.read().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@Q("STM-17", "SELECT CAST(user_id AS VARCHAR) AS order_id, max(event_id) AS seq, max_by(event_type, event_id) AS status FROM events GROUP BY 1")
def advancing(spark, events):
    """State by key that only moves forward, over micro-batches."""
    path, t = _scratch(spark), _table(spark)
    events.select(F.col("user_id").cast("string").alias("order_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")).repartition(3).write.json(path)
    stream = spark.readStream.schema("order_id string, seq bigint, status string").option("maxFilesPerTrigger", 1).json(path)
    clicks.run_available(stream, clicks.LedgerSink(t, ["order_id"], "state", combine=clicks.advance_only), _scratch(spark), mode="append")
    return t.read()


@Q("STM-03", "SELECT CASE WHEN event_id % 2 = 0 THEN 'invalid_json' ELSE 'missing_or_bad_field' END AS reason, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def rejected(spark, events):
    bad = F.when(F.col("event_id") % 2 == 0, F.lit("{broken")).otherwise(F.lit(json.dumps({"event_id": "x", "page": "p"})))
    return clicks.rejects(clicks.parse(events.select(bad.alias("value")))).groupBy("reason").agg(F.count("*").alias("n"))


@Q("SRC-19", "SELECT CAST(count(*) AS BIGINT) AS rows FROM orders")
def inventory(spark, folder):
    """Rows of the files of a table, from their footers."""
    return files.footers(spark, f"{folder}/orders.parquet").agg(F.sum("rows").alias("rows"))


@Q("SRC-22", "SELECT n_nationkey, n_name FROM nation")
def one_reader(spark, nation):
    path = _scratch(spark)
    nation.select("n_nationkey", "n_name").write.option("header", "true").csv(path)
    return files.read_any(spark, path, "csv", header="true").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@Q("SET-04", f"{_ORD}")
def concatenated(spark, orders):
    """Several files read as one table."""
    paths = [_scratch(spark) for _ in range(3)]
    for i, p in enumerate(paths):
        orders.select(*_COLS).where(F.col("o_orderkey") % 3 == i).write.parquet(p)
    return spark.read.parquet(*paths)


@Q("SNK-12", "SELECT 2 AS files, CAST(count(*) AS BIGINT) AS rows FROM orders")
def file_count(spark, orders):
    path = _scratch(spark)
    sinks.with_files(orders.select(*_COLS).repartition(6), 2).write.parquet(path)
    return files.footers(spark, path).agg(F.count("*").cast("int").alias("files"), F.sum("rows").alias("rows"))


@Q("SRT-04", "SELECT o_orderkey, o_custkey FROM orders")
def sorted_files(spark, orders):
    """Rows in ranges of the key and sorted within files, so that file statistics prune."""
    t = _table(spark)
    t.overwrite(orders.select("o_orderkey", "o_custkey").repartition(4))
    t.cluster(["o_custkey"], 4)
    return t.read()


@Q("SNK-19", "SELECT CAST(user_id AS VARCHAR) AS order_id, event_id AS seq, event_type AS status FROM events")
def event_history(spark, events):
    """History that takes each event once, though batches overlap and repeat."""
    t = _table(spark)
    rows = events.select(F.col("user_id").cast("string").alias("order_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    sink = clicks.LedgerSink(t, ["order_id", "seq"], "history")
    for number, part in enumerate(["status <> 'view'", "status <> 'error'", "status IN ('view', 'error')"]):
        sink(rows.where(part), number)
        sink(rows.where(part), number)
    return t.read()


@Q("STM-19", "SELECT e.event_id, c_name FROM events e LEFT JOIN customer ON e.user_id = c_custkey")
def stream_static(spark, events, customer):
    path, t = _click_files(spark, events), _table(spark)
    users = customer.select(F.col("c_custkey").cast("string").alias("user_id"), "c_name")
    joined = clicks.enriched(clicks.parse(clicks.replay_source(spark, path, 100)), users).select(F.col("event_id").cast("long").alias("event_id"), "c_name")
    clicks.run_available(joined, clicks.LedgerSink(t, ["event_id"], "joined"), _scratch(spark), mode="append")
    return t.read()


@Q("JON-22", """WITH l AS (SELECT event_id, user_id, date_trunc('second', ts) AS t FROM events WHERE event_type = 'view'), r AS (SELECT event_id, user_id, date_trunc('second', ts) AS t FROM events WHERE event_type = 'purchase')
SELECT l.event_id AS left_id, r.event_id AS right_id FROM l JOIN r ON l.user_id = r.user_id AND r.t >= l.t AND r.t <= l.t + INTERVAL 600 MINUTE""")  # fmt: skip
def stream_stream(spark, events):
    """Purchases up to ten hours after a view of the same user; state is bounded by both watermarks."""
    path, t = _click_files(spark, events), _table(spark)
    side = lambda page: clicks.parse(clicks.replay_source(spark, path, 100)).where(f"valid AND page = '{page}'")
    joined = clicks.matched_within(side("view"), side("purchase"), "user_id", 600, "3650 days").where("right_id IS NOT NULL")
    out = joined.select(F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id"))
    clicks.run_available(out, clicks.LedgerSink(t, ["left_id", "right_id"], "matched"), _scratch(spark), mode="append")
    return t.read()


@Q("STM-10", "SELECT CAST(count(*) AS BIGINT) AS views FROM events")
def totals(spark, events):
    """The global window in complete mode."""
    path, t = _click_files(spark, events), _table(spark)
    counts = clicks.running_totals(clicks.parse(clicks.replay_source(spark, path, 1))).select("views")
    clicks.run_available(counts, clicks.LedgerSink(t, [], "totals", combine=lambda old, new: new), _scratch(spark), mode="complete")
    return t.read()
