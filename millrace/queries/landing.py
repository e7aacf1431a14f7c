"""Landing, contracts, gates, load modes and stream rules over whole tables, beside the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace import diagnostics
from millrace.operators import dedupe, history
from millrace.plans import warehouse
from millrace.quality import contract as contracts
from millrace.quality import engine
from millrace.queries.registry import Registry
from millrace.queries.storage import _COLS, _ORD, _click_files, _scratch, _table
from millrace.sources import files, sinks
from millrace.streaming import clicks

Q = Registry()
_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1"


def _day():
    return F.date_format("ts", "yyyy-MM-dd")


def _daily(events):
    return events.groupBy(_day().alias("day")).agg(F.count("*").alias("n"))


# ---- sources ---------------------------------------------------------------------------------
@Q("SRC-03", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, strftime(ts, '%Y-%m-%d') AS dt FROM events")
def csv_by_day(spark, events):
    """CSV below ``dt=`` folders; the day comes from the path."""
    path = _scratch(spark)
    events.select("event_id", "event_type", _day().alias("dt")).repartition("dt").write.option("header", "true").partitionBy("dt").csv(path)
    return files.csv_text(spark, path).withColumn("dt", F.date_format("dt", "yyyy-MM-dd"))


def _log(spark, path):
    return spark.read.schema("`partition` int, `offset` long, value string").json(path)


@Q("SRC-11", "SELECT CAST(0 AS INT) AS part, event_id AS pos FROM events")
def replayed(spark, events):
    """A log read as a stream from its start, file by file."""
    t = _table(spark)
    rows = clicks.replay_source(spark, _click_files(spark, events)).select(F.col("partition").alias("part"), F.col("offset").alias("pos"))
    clicks.run_available(rows, clicks.LedgerSink(t, ["part", "pos"], "log"), _scratch(spark), mode="append")
    return t.read()


@Q("SRC-12", "SELECT event_id AS pos, CAST(1 AS BIGINT) AS times FROM events")
def resumed(spark, events):
    """A consumer that stops and goes on: offsets are in the checkpoint, so each row comes once."""
    path, t, ck = _scratch(spark), _table(spark), _scratch(spark)
    for condition in ("event_type = 'view'", "event_type <> 'view'"):
        events.where(condition).select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.lit("x").alias("value")).write.mode("append").json(path)
        clicks.run_available(clicks.replay_source(spark, path, 100).select(F.col("offset").alias("pos")), clicks.LedgerSink(t, ["pos"], "log", append=True), ck, mode="append")
    return t.read().groupBy("pos").agg(F.count("*").alias("times"))


Q("SRC-13", "SELECT event_id AS pos FROM events")(lambda spark, events: _log(spark, _click_files(spark, events)).select(F.col("offset").alias("pos")))


@Q("SRC-14", "SELECT CAST(event_id % 4 AS INT) AS part, max(event_id) + 1 - min(event_id) AS size, max(event_id) + 1 - coalesce(max(CASE WHEN event_type = 'view' AND event_id % 4 <> 3 THEN event_id END), 0) AS lag FROM events GROUP BY 1")
def behind(events):
    """Size and lag of each partition; one has never been committed."""
    log = events.select((F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), "event_type")
    committed = log.where("event_type = 'view' AND `partition` <> 3").groupBy("partition").agg(F.max("offset").alias("offset"))
    return clicks.topic_lag(log, committed).withColumnRenamed("partition", "part")


@Q("SRC-15", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def delivered(spark, customer):
    path = _scratch(spark)
    customer.select("c_custkey", "c_name").coalesce(1).write.option("header", "true").csv(path)
    return files.object_csv(spark, f"{path}/*.csv", ["c_custkey", "c_name"])


_CONTRACT = {
    "name": "orders", "max_quarantine_rate": 0.5,
    "columns": [{"name": "o_orderkey", "type": "bigint"}, {"name": "o_orderstatus"}, {"name": "o_totalprice", "type": "double"}],
    "checks": [
        {"type": "not_null", "column": "o_orderkey"}, {"type": "unique", "column": "o_orderkey"}, {"type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"], "severity": "soft"},
        {"type": "range", "column": "o_totalprice", "min": 0, "max": 400000}, {"type": "row_count_between", "min": 1},
    ],
}


def _text(orders):
    return orders.select(*[F.col(c["name"]).cast("string").alias(c["name"]) for c in _CONTRACT["columns"]])


@Q("SRC-16", "SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double')) t(name, kind)")
def contract_schema(spark):
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in contracts.parse(_CONTRACT).schema()], "name string, kind string")


@Q("SRC-17", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def named_view(spark, orders):
    orders.createOrReplaceTempView("silver_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM silver_orders GROUP BY 1")


@Q("SRC-18", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def ad_hoc(spark, orders):
    t = _table(spark, "o_orderstatus")
    t.overwrite(orders.select(*_COLS))
    return spark.sql("SELECT o_custkey, count(*) AS n FROM {silver} WHERE o_orderstatus = 'F' GROUP BY 1", silver=t.read())


@Q("SRC-23", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def federated(spark, nation, region):
    """One side is CSV, the other ORC: two sources meet in one plan."""
    a, b = _scratch(spark), _scratch(spark)
    nation.select("n_name", "n_regionkey").write.option("header", "true").csv(a)
    region.select("r_regionkey", "r_name").write.orc(b)
    left = files.csv_typed(spark, a, "n_name string, n_regionkey bigint")
    return left.join(F.broadcast(files.read_any(spark, b, "orc")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@Q("SRC-24", _ORD)
def globbed(spark, orders):
    path = _scratch(spark)
    orders.select(*_COLS).repartition(5).write.parquet(path)
    return spark.read.parquet(f"{path}/*.parquet")


# ---- sinks and load modes --------------------------------------------------------------------
@Q("SNK-06", _DAILY)
def daily_summary(spark, events):
    """A day's aggregate replaces the one before; running again changes nothing."""
    t = _table(spark)
    t.merge(_daily(events.where("event_type <> 'view'")), ["day"], "n")
    for _ in range(2):
        t.merge(_daily(events), ["day"], "n", strict=False)
    return t.read()


@Q("SNK-07", "SELECT k AS run, CAST((SELECT count(*) FROM orders) AS BIGINT) AS rows FROM (VALUES (1), (2)) t(k)")
def run_log(spark, orders):
    path = _scratch(spark)
    for k in (1, 2):
        orders.agg(F.lit(k).alias("run"), F.count("*").alias("rows")).write.mode("append").json(path)
    return spark.read.schema("run int, rows bigint").json(path)


@Q("SNK-11", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS event_date FROM events")
def by_date(spark, events):
    path = _scratch(spark)
    sinks.by_partition(events.select("event_id", _day().alias("event_date")), path, ["event_date"])
    return spark.read.parquet(path).select("event_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@Q("SNK-13", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders")
def no_sink(orders):
    orders.write.format("noop").mode("overwrite").save()
    return orders.agg(F.count("*").alias("n"))


@Q("SNK-17", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def schema_overwrite(spark, orders):
    t = _table(spark)
    t.overwrite(orders.select(*_COLS))
    t.overwrite(orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return t.read()


@Q("SNK-20", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def ledger(spark, events):
    """Sums that would double if a batch counted twice; each is delivered twice."""
    t = _table(spark)
    add = lambda old, new: (new if old is None else old.unionByName(new)).groupBy("event_type").agg(F.sum("n").alias("n"))
    sink = clicks.LedgerSink(t, ["event_type"], "sums", combine=add)
    for number, part in enumerate(["value < 50", "value >= 50 OR value IS NULL"]):
        batch = events.where(part).groupBy("event_type").agg(F.count("*").alias("n"))
        sink(batch, number)
        sink(batch, number)
    return t.read()


@Q("SNK-21", _DAILY)
def absolute_upsert(spark, events):
    """Totals, not increments: the later total of a window replaces the earlier one."""
    t = _table(spark)
    sink = clicks.LedgerSink(t, ["day"], "totals")
    sink(_daily(events.where("event_type = 'view'")), 0)
    sink(_daily(events), 1)
    return t.read()


@Q("SNK-24", _ORD)
def reload(spark, orders):
    t = _table(spark)
    for _ in range(2):
        t.overwrite(orders.select(*_COLS))
    return t.read()


@Q("SNK-26", "SELECT 'append' AS mode, CAST(2 * count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'overwrite', count(*) FROM orders UNION ALL SELECT 'merge', count(*) FROM orders")
def load_modes(spark, orders):
    """The same load twice in each mode."""
    rows, out = orders.select("o_orderkey", "o_totalprice", "o_orderdate"), None
    loads = {"append": lambda t: t.append(rows), "overwrite": lambda t: t.overwrite(rows), "merge": lambda t: t.merge(rows, ["o_orderkey"], "o_orderdate")}
    for mode, load in loads.items():
        t = _table(spark)
        load(t)
        load(t)
        n = t.read().agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@Q("SRT-05", "SELECT CAST(0 AS BIGINT) AS overlapping, CAST(count(*) AS BIGINT) AS n FROM orders")
def ranges(spark, orders):
    """Rows in ranges of a key: no two files' ranges overlap, so their statistics prune."""
    path = _scratch(spark)
    orders.select("o_custkey").repartitionByRange(6, "o_custkey").write.parquet(path)
    each = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b"), F.count("*").alias("n"))
    hit = F.expr("exists(all, o -> o.f <> f AND o.a <= b AND o.b >= a)")
    listed = each.agg(F.collect_list(F.struct("f", "a", "b")).alias("all"))
    return each.join(F.broadcast(listed)).agg(F.count_if(hit).alias("overlapping"), F.sum("n").alias("n"))


@Q("AGG-25", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS qty, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def two_phase(lineitem):
    """Partial sums by key and salt, then by key: a hot key is spread over the salts."""
    salt = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(16)).alias("salt")
    part = lineitem.groupBy("l_returnflag", salt).agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("q"), F.count("*").alias("c"))
    return part.groupBy("l_returnflag").agg(F.sum("q").cast("decimal(22,2)").alias("qty"), F.sum("c").alias("n"))


# ---- lake tables -----------------------------------------------------------------------------
@Q("LAK-01", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def lake_cycle(spark, events):
    """Merge, cluster, compact and vacuum; the rows stay."""
    t = _table(spark)
    rows = events.select("user_id", "event_id")
    t.merge(dedupe.latest_by_aggregate(rows, ["user_id"], ["event_id"]), ["user_id"], "event_id")
    t.cluster(["user_id"], 4)
    t.compact(1)
    t.vacuum(1, dry_run=False)
    return t.read()


@Q("LAK-02", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def hidden_partition(spark, events):
    """A partition derived from a time; files are rewritten and old versions expire."""
    t = _table(spark, "month")
    t.overwrite(events.select("event_id", F.date_format("ts", "yyyy-MM").alias("month")))
    t.compact(1)
    t.vacuum(1, dry_run=False)
    return t.read()


@Q("LAK-03", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def upsert(spark, events):
    """A record key and a precombine column: the batch is reduced first, then merged."""
    t = _table(spark)
    for kind in ("event_type <> 'view'", "event_type = 'view'"):
        rows = events.where(kind).select("user_id", "event_id", "event_type")
        t.merge(dedupe.latest_by_aggregate(rows, ["user_id"], ["event_id"]), ["user_id"], "event_id")
    return t.read()


@Q("LAK-05", "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def months(spark, orders):
    path = _scratch(spark)
    sinks.by_partition(orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")), path, ["month"])
    return spark.read.schema("o_orderkey bigint, month string").parquet(path).where("month BETWEEN '1996-01' AND '1996-12'").groupBy("month").agg(F.count("*").alias("n"))


# ---- contracts and gates ---------------------------------------------------------------------
@Q("DQ-11", "SELECT 'missing column o_orderstatus' AS fault UNION ALL SELECT 'unexpected column note'")
def schema_check(spark, orders):
    odd = _text(orders).drop("o_orderstatus").withColumn("note", F.lit("x"))
    return spark.createDataFrame([(f,) for f in engine.schema_faults(odd.columns, contracts.parse(_CONTRACT))], "fault string")


_GATE = "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE o_totalprice > 400000) AS BIGINT) AS quarantined FROM orders"


@Q("DQ-12", f"SELECT 'published' AS status, * FROM ({_GATE}) t")
def gate(spark, orders):
    out = engine.run(_text(orders), contracts.parse(_CONTRACT))
    return spark.createDataFrame([(out.status, out.rows, out.quarantined)], "status string, rows bigint, quarantined bigint")


@Q("DQ-25", """SELECT * FROM (SELECT 'range:o_totalprice' AS id, CAST(count(*) FILTER (WHERE o_totalprice > 400000) AS DOUBLE) AS observed FROM orders UNION ALL SELECT 'accepted_values:o_orderstatus', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'unique:o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'not_null:o_orderkey', 0.0 UNION ALL SELECT 'row_count_between:', count(*) FROM orders) t""")
def suite(spark, orders):
    """A suite of expectations answered by one aggregation."""
    out = engine.run(_text(orders), contracts.parse(_CONTRACT))
    return spark.createDataFrame([(r.id, r.observed) for r in out.results if not r.id.startswith(("schema", "type_cast"))], "id string, observed double")


@Q("DQ-27", f"SELECT 'dq_rows{{contract=\"orders\"}} ' || rows AS line FROM ({_GATE}) t UNION ALL SELECT 'dq_quarantined_rows{{contract=\"orders\"}} ' || quarantined FROM ({_GATE}) t")
def exposition(spark, orders):
    text = engine.metrics(engine.run(_text(orders), contracts.parse(_CONTRACT)), "orders")
    return spark.createDataFrame([(x,) for x in text.splitlines() if x.startswith(("dq_rows{", "dq_quarantined_rows{"))], "line string")


_MAD = f"WITH d AS ({_DAILY}), m AS (SELECT quantile_cont(n, 0.5) AS mid FROM d), a AS (SELECT mid, quantile_cont(abs(n - mid), 0.5) AS mad FROM d, m GROUP BY mid)"
Q("DQ-14", f"{_MAD} SELECT day, 0.6745 * (n - mid) / greatest(mad, 0.01 * abs(mid), 1e-9) AS score FROM d, a")(lambda events: engine.robust_scores(_daily(events), "n").select("day", "score"))
Q("DQ-15", f"{_MAD} SELECT day, CASE WHEN mad > 0 THEN (n - mid) / (1.4826 * mad) WHEN n = mid THEN 0.0 END AS strict FROM d, a")(lambda events: engine.robust_scores(_daily(events), "n").select("day", "strict"))
Q("DQ-10", f"{_MAD} SELECT day FROM d, a WHERE abs(0.6745 * (n - mid) / greatest(mad, 0.01 * abs(mid), 1e-9)) > 1")(lambda events: engine.robust_scores(_daily(events), "n").where("abs(score) > 1").select("day"))
Q("DQ-26", f"WITH d AS ({_DAILY}) SELECT day, n > (SELECT avg(n) + stddev_samp(n) FROM d) AS above_sigma, n > (SELECT 2.5 * quantile_cont(n, 0.75) - 1.5 * quantile_cont(n, 0.25) FROM d) AS above_iqr FROM d")(
    lambda events: _daily(events).join(F.broadcast(_daily(events).agg((F.avg("n") + F.stddev_samp("n")).alias("s"), (2.5 * F.percentile("n", 0.75) - 1.5 * F.percentile("n", 0.25)).alias("q")))).select("day", (F.col("n") > F.col("s")).alias("above_sigma"), (F.col("n") > F.col("q")).alias("above_iqr"))
)


@Q("DQ-16", "SELECT true AS approved, CAST(count(*) AS BIGINT) AS read, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS rejected FROM events")
def daily_gate(spark, events):
    a = events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad")).first()
    done = engine.batch_gate(a["n"], a["bad"], 0, 1.0, [], most_rejects=0.5)
    return spark.createDataFrame([(done["approved"], a["n"], a["bad"])], "approved boolean, read bigint, rejected bigint")


@Q("DQ-17", "SELECT count(*) FILTER (WHERE event_type = 'error') > 0.10 * count(*) AS stopped FROM events")
def stopped(spark, events):
    a = events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad")).first()
    try:
        engine.reject_gate(a["n"], a["bad"], 0.10)
        return spark.createDataFrame([(False,)], "stopped boolean")
    except ValueError:
        return spark.createDataFrame([(True,)], "stopped boolean")


@Q("DQ-21", "SELECT 36.0::DOUBLE AS age_hours, 'warn' AS status")
def fresh(events):
    """Judged a day and a half after the last event."""
    now = events.agg(F.max("ts").cast("timestamp").alias("t")).first()["t"]
    return warehouse.freshness(events, "ts", F.lit(now) + F.expr("INTERVAL 36 HOURS"))


@Q("DQ-20", "SELECT CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 100000000 THEN 'error' WHEN count(*) FILTER (WHERE event_type = 'error') >= 1 THEN 'warn' ELSE 'pass' END AS verdict FROM events")
def severity(spark, events):
    return spark.createDataFrame([(warehouse.verdict(events.where("event_type = 'error'").count(), 1, 100_000_000),)], "verdict string")


@Q("GOV-04", "SELECT 'type:' || event_type AS node, CAST(2 AS INT) AS depth FROM events GROUP BY event_type UNION ALL SELECT DISTINCT 'user:' || user_id, 1 FROM events")
def downstream(events):
    """Everything that hangs below one source: users, then the types they use."""
    users = events.select(F.lit("raw").alias("upstream"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("downstream")).distinct()
    kinds = events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("upstream"), F.concat(F.lit("type:"), "event_type").alias("downstream")).distinct()
    return warehouse.impact(users.unionByName(kinds), "raw")


@Q("GOV-05", "SELECT 'backward' AS way, 'new required column o_note' AS fault UNION ALL SELECT 'backward', 'o_totalprice: DOUBLE does not read as BIGINT'")
def compatible(spark):
    old = contracts.parse(_CONTRACT)
    columns = [*_CONTRACT["columns"][:2], {"name": "o_totalprice", "type": "bigint"}, {"name": "o_note"}]
    found = contracts.compatibility(old, contracts.parse({"name": "orders", "columns": columns}))
    return spark.createDataFrame([(way, f) for way, faults in found.items() for f in faults], "way string, fault string")


# ---- history and increments ------------------------------------------------------------------
_OLD = "TIMESTAMP '2020-01-01 00:00:00'"
_NEW = "TIMESTAMP '2021-01-01 00:00:00'"


def _snapshot(customer, compare):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rich = F.col("c_acctbal") > 0
    dim = customer.select("c_custkey", "c_mktsegment", at("2020-01-01").alias("at"), at("2020-01-01").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    batch = customer.select("c_custkey", F.when(rich & (F.col("c_mktsegment") != "BUILDING"), "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(rich, at("2021-01-01")).otherwise(at("2020-01-01")).alias("at"))
    return history.scd2_apply(dim, batch, "c_custkey", "at", compare).select("c_custkey", "c_mktsegment", "valid_from", "valid_to")


def _snapshot_sql(changed):
    return f"""SELECT c_custkey, c_mktsegment, {_OLD} AS valid_from, CASE WHEN {changed} THEN {_NEW} END AS valid_to FROM customer UNION ALL
SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'MOVED' ELSE c_mktsegment END, {_NEW}, NULL FROM customer WHERE {changed}"""


Q("MOD-03", _snapshot_sql("c_acctbal > 0"))(lambda customer: _snapshot(customer, None))
Q("MOD-04", _snapshot_sql("c_acctbal > 0 AND c_mktsegment <> 'BUILDING'"))(lambda customer: _snapshot(customer, ["c_mktsegment"]))


@Q("INC-02", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 3 THEN 'new' ELSE 'old' END AS v FROM events")
def last_days(spark, events):
    """The last three days' partitions are written again, all others stay."""
    t = _table(spark, "day")
    rows = events.select("event_id", F.to_date("ts").alias("d"), _day().alias("day"))
    t.overwrite(rows.select("event_id", F.lit("old").alias("v"), "day"))
    first = rows.agg(F.date_sub(F.max("d"), 3).alias("first"))
    t.overwrite_partitions(rows.join(F.broadcast(first)).where("d > first").select("event_id", F.lit("new").alias("v"), "day"))
    return t.read().select("event_id", "day", "v")


@Q("INC-03", _DAILY)
def backfill(spark, events):
    """Every day twice, in one write each time; the result is as of one run."""
    path = _scratch(spark)
    for _ in range(2):
        sinks.replace_partitions(_daily(events).repartition("day"), path, ["day"])
    return spark.read.schema("n bigint, day string").parquet(path).select("day", "n")


# ---- streams ---------------------------------------------------------------------------------
def _value():
    """Errors as broken text, clicks without most fields, all others whole."""
    text = lambda c: F.col(c).cast("string").alias(c)
    whole = F.struct(text("event_id"), text("user_id"), F.col("event_type").alias("page"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"))
    return F.when(F.col("event_type") == "error", F.lit("{broken")).when(F.col("event_type") == "click", F.to_json(F.struct(text("event_id")))).otherwise(F.to_json(whole))


def _parsed(events):
    return clicks.parse(events.select(F.col("event_id").alias("id"), _value().alias("value")))


Q("STM-01", "SELECT event_id AS id, event_type = 'error' AS bad_json, CASE WHEN event_type NOT IN ('error', 'click') THEN event_type END AS page FROM events")(lambda events: _parsed(events).select("id", "bad_json", "page"))
Q("STM-02", "SELECT event_id AS id, event_type NOT IN ('error', 'click') AS valid FROM events")(lambda events: _parsed(events).select("id", "valid"))
_WINDOWS = "SELECT time_bucket(INTERVAL 1 MINUTE, date_trunc('second', ts)) AS window_start, event_type AS page, CAST(count(*) AS BIGINT) AS views, CAST(count(DISTINCT user_id) AS INT) AS users FROM events GROUP BY 1, 2"


def _counted(spark, events, mode, watermark, twice=False):
    path, t = _click_files(spark, events.unionAll(events) if twice else events), _table(spark)
    counts = clicks.windowed_counts(clicks.parse(clicks.replay_source(spark, path, 100)), watermark=watermark)
    query = clicks.run_available(counts, clicks.LedgerSink(t, ["window_start", "page"], "counts"), _scratch(spark), mode=mode)
    return t, query


def _local(t):
    return t.read().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


Q("STM-05", _WINDOWS)(lambda spark, events: _local(_counted(spark, events, "update", "3650 days", twice=True)[0]))
Q("STM-06", _WINDOWS)(lambda spark, events: _local(_counted(spark, events, "update", "3650 days")[0]))
Q("STM-11", f"SELECT * FROM ({_WINDOWS}) t WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(date_trunc('second', ts)) FROM events) - INTERVAL 120 SECOND")(lambda spark, events: _local(_counted(spark, events, "append", "120 seconds")[0]))


@Q("STM-04", "SELECT strftime(max(date_trunc('second', ts)) - INTERVAL 120 SECOND, '%Y-%m-%dT%H:%M:%S') AS watermark FROM events")
def watermark(spark, events):
    _, query = _counted(spark, events, "update", "120 seconds")
    return spark.createDataFrame([(clicks.progress(query)["watermarks"][-1][:19],)], "watermark string")


@Q("STM-14", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS dropped_late FROM events")
def reported(spark, events):
    _, query = _counted(spark, events, "update", "3650 days")
    p = clicks.progress(query)
    return spark.createDataFrame([(p["rows"], p["dropped_late"])], "rows bigint, dropped_late bigint")


@Q("STM-16", "SELECT CASE WHEN event_type = 'error' THEN 'invalid_json' WHEN event_type = 'click' THEN 'missing_or_bad_field' ELSE 'valid' END AS kind, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def reject_first(spark, events):
    """Within a batch rejects are written before the data; the offset is committed after both."""
    path, good, bad = _scratch(spark), _table(spark), _table(spark)
    events.select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"), _value().alias("value")).repartition(3).write.json(path)
    data, dead = clicks.LedgerSink(good, [], "data", append=True), clicks.LedgerSink(bad, [], "dead", append=True)

    def both(batch, number):
        dead(clicks.rejects(batch).select(F.col("reason").alias("kind")), number)
        data(batch.where("valid").select(F.lit("valid").alias("kind")), number)

    clicks.run_available(clicks.parse(clicks.replay_source(spark, path)), both, _scratch(spark), mode="append")
    return good.read().unionByName(bad.read()).groupBy("kind").agg(F.count("*").alias("n"))


Q("STM-20", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")(
    lambda events: events.where("event_type = 'purchase'").groupBy(F.window("ts", "5 minutes"), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")
)
Q.sql("STM-21", "SELECT CAST(window.start AS timestamp_ntz) AS window_start, sum(1) AS n FROM events GROUP BY window(ts, '10 minutes')", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1", tables="events")
# ---- diagnostics and DataFrame surface -------------------------------------------------------
@Q("DIA-01", "SELECT true AS pushed, true AS pruned")
def pushed(spark, lineitem):
    """The filter reaches the scan, and the scan reads two columns."""
    df = lineitem.where("l_quantity > 40").select("l_orderkey", "l_quantity")
    lines = diagnostics.plan_lines(df, "PushedFilters|ReadSchema")
    return spark.createDataFrame([(any("GreaterThan(l_quantity" in x for x in lines), any("ReadSchema" in x and "l_shipdate" not in x for x in lines))], "pushed boolean, pruned boolean")


@Q("DIA-04", "SELECT CAST(count(DISTINCT strftime(ts, '%Y-%m-%d')) AS BIGINT) AS total, CAST(1 AS BIGINT) AS scanned FROM events")
def pruned(spark, events):
    t = _table(spark, "day")
    t.overwrite(events.select("event_id", _day().alias("day")).repartition("day"))
    day = events.agg(F.max(_day())).first()[0]
    p = t.pruning("day", day, day)
    return spark.createDataFrame([(p["files_total"], p["files_scanned"])], "total bigint, scanned bigint")


Q("API-08", "SELECT o_orderstatus, max(o_orderkey) AS last FROM orders WHERE o_totalprice > 1000 GROUP BY 1")(lambda orders: orders.where("o_totalprice > 1000").groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("last")))
Q("API-11", "SELECT n_nationkey, n_name FROM nation")(lambda spark, nation: spark.createDataFrame(nation.select("n_nationkey", "n_name").toArrow()))
Q("API-13", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")(lambda spark, orders: (sinks.by_partition(orders.select("o_orderkey", "o_orderstatus"), p := _scratch(spark), ["o_orderstatus"]), spark.read.parquet(p).where("o_orderstatus = 'O'").select("o_orderkey"))[1])


@Q("API-14", "SELECT codec, CAST((SELECT count(*) FROM orders) AS BIGINT) AS n FROM (VALUES ('snappy'), ('zstd'), ('gzip'), ('none')) t(codec)")
def codecs(spark, orders):
    out = None
    for codec in ("snappy", "zstd", "gzip", "none"):
        path = _scratch(spark)
        orders.select(*_COLS).write.option("compression", codec).parquet(path)
        n = files.footers(spark, path).agg(F.lit(codec).alias("codec"), F.sum("rows").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


Q("API-20", "SELECT trim(lower(event_type)) AS kind, user_id, max(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")(
    lambda events: dedupe.latest(events.where("user_id IS NOT NULL").select(F.trim(F.lower("event_type")).alias("kind"), "user_id", "event_id"), ["kind", "user_id"], [F.col("event_id").desc()])
)


@Q("API-21", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def keep_latest(orders):
    """Doing it twice is doing it once."""
    once = dedupe.latest(orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return dedupe.latest(once, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@Q("UDF-07", "SELECT o_orderkey, o_orderstatus = 'F' AS archived FROM orders")
def archive(spark, orders):
    """Rows go to the archive first and are then deleted from the table."""
    live, kept = _table(spark), _table(spark)
    live.overwrite(orders.select(*_COLS))
    kept.overwrite(live.read().where("o_orderstatus = 'F'"))
    live.delete_where("o_orderstatus = 'F'")
    mark = lambda t, flag: t.read().select("o_orderkey", F.lit(flag).alias("archived"))
    return mark(live, False).unionByName(mark(kept, True))


@Q("JON-24", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def co_located(spark, orders, lineitem):
    """Both sides bucketed alike on the key: the join itself moves nothing."""
    a, b = (f"{n}_{uuid.uuid4().hex}" for n in ("orders", "lines"))
    sinks.bucketed(orders.select("o_orderkey", "o_orderstatus"), a, 8, "o_orderkey", _scratch(spark))
    sinks.bucketed(lineitem.select("l_orderkey", "l_linenumber"), b, 8, "l_orderkey", _scratch(spark))
    joined = spark.table(a).hint("merge").join(spark.table(b), F.col("o_orderkey") == F.col("l_orderkey"))
    assert diagnostics.count_exchanges(joined) == 0
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@Q("LAK-04", "SELECT c_custkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def clustered(spark, orders, customer):
    """A table bucketed on its key is aggregated without a shuffle, then meets another."""
    name = f"orders_{uuid.uuid4().hex}"
    sinks.bucketed(orders.select("o_custkey", "o_orderkey"), name, 8, "o_custkey", _scratch(spark))
    each = spark.table(name).groupBy("o_custkey").agg(F.count("*").alias("n"))
    assert diagnostics.count_exchanges(each) == 0
    return each.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "n")


@Q("STM-15", "SELECT true AS same_version, CAST(count(*) AS BIGINT) AS views FROM events")
def restarted(spark, events):
    """A restart with nothing new commits no version."""
    path, t, ck, seen = _click_files(spark, events), _table(spark), _scratch(spark), []
    for _ in range(2):
        counts = clicks.windowed_counts(clicks.parse(clicks.replay_source(spark, path, 100)), watermark="3650 days")
        clicks.run_available(counts, clicks.LedgerSink(t, ["window_start", "page"], "counts"), ck)
        seen.append(t.versions()[-1])
    return t.read().agg(F.lit(seen[0] == seen[1]).alias("same_version"), F.sum("views").alias("views"))


@Q("STM-12", "SELECT event_id AS pos FROM events")
def in_steps(spark, events):
    """``availableNow`` takes what is there in as many batches as the source's limit asks for."""
    t = _table(spark)
    query = clicks.run_available(clicks.replay_source(spark, _click_files(spark, events), 1).select(F.col("offset").alias("pos")), clicks.LedgerSink(t, ["pos"], "log", append=True), _scratch(spark), mode="append")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) > 1
    return t.read()


@Q("UDF-08", "SELECT event_type, exp(avg(ln(1 + value))) - 1 AS geometric FROM events WHERE value IS NOT NULL GROUP BY 1")
def custom_aggregate(events):
    """An aggregate that Spark lacks, as expressions: partial sums before the shuffle, no Python."""
    return events.where("value IS NOT NULL").groupBy("event_type").agg((F.exp(F.avg(F.log1p("value"))) - 1).alias("geometric"))


@Q("API-01", "SELECT kind, CAST((SELECT count(*) FROM orders) AS BIGINT) AS n FROM (VALUES ('csv'), ('json'), ('parquet'), ('orc')) t(kind)")
def readers(spark, orders):
    out = None
    for kind in ("csv", "json", "parquet", "orc"):
        path = _scratch(spark)
        orders.select("o_orderkey", "o_orderstatus").write.format(kind).save(path)
        n = spark.read.format(kind).schema("o_orderkey bigint, o_orderstatus string").load(path).agg(F.lit(kind).alias("kind"), F.count("o_orderkey").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@Q("API-12", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def arrow_files(spark, lineitem):
    """zstd files, read with a filter and two columns, both of which reach the scan."""
    path = _scratch(spark)
    lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path).where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    assert diagnostics.plan_lines(out, r"PushedFilters.*GreaterThan\(l_quantity")
    return out


Q("API-18", "SELECT CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total FROM lineitem WHERE l_discount > 0.05")(
    lambda lineitem: lineitem.where("l_discount > 0.05").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total"))
)


@Q("API-23", "SELECT CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS missing, CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS repeated, CAST(count(*) FILTER (WHERE value < 1) AS BIGINT) AS small FROM events")
def required_unique_min(events):
    checks = [contracts.Check("m", "not_null", column="value"), contracts.Check("s", "range", column="value", options={"min": 1})]
    return events.agg(F.count_if(engine.violates(checks[0])).alias("missing"), (F.count("*") - F.countDistinct("event_id")).alias("repeated"), F.count_if(engine.violates(checks[1])).alias("small"))
