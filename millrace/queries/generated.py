"""Generators and the small helpers around files and days, beside the SQL that states the same rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.functions import features
from millrace.lake import LakeTable
from millrace.plans.lakehouse import store_bronze
from millrace.quality.validators import etl_orders
from millrace.queries.registry import Registry
from millrace.queries.storage import _scratch
from millrace.sources import generators, store
from millrace.sources.files import json_lines
from millrace.streaming import clicks

Q = Registry()


def _u(h: str, place: int) -> str:
    return f"(('0x' || substr({h}, {6 * place + 1}, 6))::BIGINT::DOUBLE / 16777216)"


def _n(h: str, place: int, n: int) -> str:
    return f"CAST(floor({_u(h, place)} * {n}) AS BIGINT)"


def _of(values: list, n: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({n}) + 1]"


def _at(seconds: str) -> str:
    return f"make_timestamp(({seconds})::BIGINT * 1000000)"


_EVENTS = f"""SELECT id AS event_id, CASE WHEN {_u('h', 0)} < 0.4 THEN 0 ELSE {_n('h', 1, 5000)} END AS user_id, {_of(generators.EVENT_TYPES, _n('h', 2, 5))} AS event_type, {_n('h', 3, 20000)} / 100 AS amount,
{_at(f"1704067200 + floor({_u('h', 4)} * 30 * 86400)")} AS event_ts FROM (SELECT i AS id, md5('7:event:' || i) AS h FROM range(200000) t(i)) x"""


@Q("GEN-01", _EVENTS)
def events_made(spark):
    return generators.make_events(spark, 200_000, 5_000).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


Q("GEN-01b", f"SELECT i AS user_id, {_of(generators.COUNTRIES, 'i % 8')} AS country, DATE '2023-01-01' + CAST(i % 365 AS INT) AS signup_date, 'user_' || i AS name FROM range(20000) t(i)")(lambda spark: generators.make_users(spark, 20_000))


@Q("GEN-02", f"""WITH r AS (SELECT CASE WHEN {_u('k', 0)} < 0.06 THEN {_of(generators.DEFECTS, _n('k', 1, 8))} END AS defect FROM (SELECT md5('42:defect:' || i) AS k FROM range(50000) t(i)) x)
SELECT coalesce(defect, 'clean') AS defect, CAST(count(*) + CASE WHEN defect IS NULL THEN (SELECT count(*) FROM r WHERE defect = 'duplicate') ELSE 0 END AS BIGINT) AS rows, CAST(CASE WHEN defect IS NULL OR defect = 'duplicate' THEN 0 ELSE count(*) END AS BIGINT) AS rejected FROM r GROUP BY defect""")
def defects(spark):
    """Dirty orders through their validator: each defect is found, and nothing else is rejected."""
    rows = generators.dirty_orders(spark, 50_000).withColumn("planted", F.coalesce("defect", F.lit("clean"))).drop("defect")
    checked = etl_orders(rows)
    right = F.col("reason").eqNullSafe(F.when(~F.col("planted").isin("clean", "duplicate"), F.col("planted")))
    return checked.groupBy(F.when(right, F.col("planted")).otherwise("wrong").alias("defect")).agg(F.count("*").alias("rows"), F.count("reason").alias("rejected"))


Q("GEN-03", f"""SELECT printf('C%05d', i) AS customer_id, {_of(generators.UFS, f"({_n('h', 0, 8)} + m) % 8")} AS uf, {_of(generators.SEGMENTS, f"({_n('h', 1, 3)} + m) % 3")} AS segment, CASE WHEN m = 1 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
FROM (SELECT i, md5('7:customer:' || i) AS h, CASE WHEN i % 10 = 0 THEN 1 ELSE 0 END AS m FROM range(1, 201) t(i)) x""")(lambda spark: generators.shop(spark, 2)["customers"].withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")))  # fmt: skip
Q("GEN-03b", f"""WITH o AS (SELECT i, md5('7:sale:' || i) AS h FROM range(1, 1801) t(i)), l AS (SELECT printf('O%07d', i) AS order_id, unnest(range(1, {_n('h', 3, 4)} + 2)) AS line_no FROM o), d AS (SELECT *, md5('7:line:' || order_id || ':' || line_no) AS h FROM l)
SELECT order_id, CAST(line_no AS INT) AS line_no, printf('P%04d', {_n('h', 0, 50)} + 1) AS product_id, CAST({_n('h', 1, 5)} + 1 AS INT) AS quantity, CAST({_of([0.0, 0.05, 0.1, 0.15], _n('h', 2, 4))} AS DOUBLE) AS discount FROM d""")(lambda spark: generators.shop(spark, 2)["order_items"])  # fmt: skip
Q("GEN-03c", f"""SELECT printf('O%07d', i) AS order_id, printf('C%05d', {_n('h', 1, 200)} + 1) AS customer_id, {_at(f"CASE WHEN i <= 1500 THEN 1704067200 + {_n('h', 0, 30 * 86400)} ELSE 1706745600 + {_n('h', 0, 14 * 86400)} END")} AS order_ts, {_of(generators.STATUSES, _n('h', 2, 4))} AS status
FROM (SELECT i, md5('7:sale:' || i) AS h FROM range(1, 1801) t(i)) x""")(lambda spark: generators.shop(spark, 2)["orders"].withColumn("order_ts", F.col("order_ts").cast("timestamp_ntz")))  # fmt: skip
_CYCLES = "[" + ", ".join(repr(c) for c in generators.LIFECYCLES) + "]"
Q("GEN-04", f"""WITH o AS (SELECT i, md5('42:lifecycle:' || i) AS h FROM range(5000) t(i)), c AS (SELECT i, h, ({_CYCLES})[{_n('h', 0, 3)} + 1] AS cycle FROM o), e AS (SELECT i, h, cycle, unnest(range(len(cycle))) AS place FROM c)
SELECT printf('O%07d', i) AS order_id, CAST(place + 1 AS INT) AS seq, printf('C%04d', {_n('h', 1, 500)} + 1) AS customer_id, cycle[place + 1] AS status, CAST({_n('h', 2, 50000)} / 100 + 1 AS DECIMAL(12,2)) AS amount, {_at(f"1704067200 + 3 * i + place * (5 + {_n('h', 3, 595)})")} AS event_ts FROM e""")(
    lambda spark: generators.order_events(spark, 5_000).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
)


def _late(spark):
    """The three deliveries through the streaming job, a micro-batch each; the counts table, rows dropped as late, and rejected lines."""
    folder, checkpoint, table = _scratch(spark), _scratch(spark), LakeTable(spark, _scratch(spark))
    late = rejects = 0
    for n, phase in enumerate(generators.late_phases()):
        lines = [json.dumps({"partition": 0, "offset": i, "value": v}) for i, v in enumerate(phase.lines)]
        store.write_text(spark, f"{folder}/{n}.json", "\n".join(lines) + "\n")
        parsed = clicks.parse(clicks.replay_source(spark, folder))
        done = clicks.run_available(clicks.windowed_counts(parsed), clicks.LedgerSink(table, ["window_start", "page"], "counts"), checkpoint)
        late += clicks.progress(done)["dropped_late"]
        rejects += clicks.rejects(clicks.parse(spark.createDataFrame([(v,) for v in phase.lines], "value string"))).count()
    return table.read(), late, rejects


@Q("GEN-05", "SELECT * FROM (VALUES ('views', CAST(663 AS BIGINT)), ('duplicates', 15), ('late', 18), ('rejects', 3)) t(kind, n)")
def late_totals(spark):
    counts, late, rejects = _late(spark)
    views = counts.agg(F.sum("views")).first()[0]
    valid = sum(len(p.lines) for p in generators.late_phases()) - rejects
    return spark.createDataFrame([("views", views), ("duplicates", valid - views - late), ("late", late), ("rejects", rejects)], "kind string, n long")


@Q("STM-07", "SELECT TIMESTAMP '2024-03-01 12:00:00' + INTERVAL (m) MINUTE AS window_start, CAST(CASE WHEN m = 8 THEN 48 WHEN m = 9 THEN 47 WHEN m = 12 THEN 48 ELSE 40 END AS BIGINT) AS views FROM range(16) t(m)")
def late_windows(spark):
    """Late rows within the watermark open their window again, later ones are dropped: minutes 2 and 10 stay as they were."""
    counts = _late(spark)[0]
    return counts.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.sum("views").alias("views"))


Q("WIN-12", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS _rn FROM orders")(lambda orders: features.row_index(orders.select("o_orderkey"), "o_orderkey"))


@Q("SNK-04", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation")
def summary_file(spark, nation):
    """A small file that appears whole, and is replaced whole."""
    path = f"{_scratch(spark)}/summary.json"
    for n in (0, nation.count()):
        store.write_text(spark, path, json.dumps({"n": n}), replace=True)
    return spark.createDataFrame([(json.loads(store.read_text(spark, path))["n"],)], "n long")


@Q("SNK-09", "SELECT r_name, CAST(count(*) AS BIGINT) AS lines FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def bronze(spark, nation, region):
    """A delivery for each region, stored twice: named by content, the second time changes nothing."""
    folder = _scratch(spark)
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list(F.to_json(F.struct("r_name", "n_name")))).alias("lines"))
    for r in rows.collect() * 2:
        store_bronze(folder, "2024-01-01", ("\n".join(r["lines"]) + "\n").encode())
    return json_lines(spark, f"{folder}/*/*.jsonl").groupBy(F.get_json_object("raw", "$.r_name").alias("r_name")).agg(F.count("*").alias("lines"))


@Q("PRD-02", """WITH p AS (SELECT user_id, count(*) AS expected FROM events GROUP BY 1), a AS (SELECT user_id, event_id FROM events WHERE event_type <> 'error' UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, count(*) AS delivered, count(DISTINCT event_id) AS found FROM a GROUP BY 1)
SELECT p.user_id, CAST(expected AS BIGINT) AS expected, CAST(coalesce(found, 0) AS BIGINT) AS found, CAST(coalesce(delivered - found, 0) AS BIGINT) AS repeated, expected = coalesce(found, 0) AS complete FROM p LEFT JOIN f ON p.user_id = f.user_id""")
def end_state(events):
    """What was produced against what arrived: errors were lost on the way, purchases came twice."""
    rows = events.select("user_id", "event_id", "event_type")
    arrived = rows.where("event_type <> 'error'").unionByName(rows.where("event_type = 'purchase'"))
    found = arrived.groupBy("user_id", "event_id").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("found"), F.sum(F.col("n") - 1).alias("repeated"))
    produced = rows.groupBy("user_id").agg(F.count("*").alias("expected"))
    out = produced.join(found, "user_id", "full").fillna(0, ["expected", "found", "repeated"])
    return out.withColumn("complete", F.col("expected") == F.col("found"))
