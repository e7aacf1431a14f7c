"""Queries that run the library's operators on the given tables, with SQL that reaches the same rows another way."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import diagnostics
from millrace.functions import features, scalars, vectors
from millrace.operators import dedupe, history, joins, series
from millrace.plans import graph, warehouse
from millrace.queries.registry import Registry

Q = Registry()
MONEY = "decimal(12,2)"


# ---- scans -----------------------------------------------------------------------------------
@Q("SRC-07", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_quantity > 40")
def scan(lineitem):
    return lineitem.where("l_shipdate >= timestamp_ntz'1996-01-01 00:00:00' and l_quantity > 40").select("l_orderkey", "l_quantity")


@Q("SRC-20", "SELECT n_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def models(spark, customer, nation):
    m = warehouse.Models(spark)
    m.source("raw_customer", customer)
    m.source("raw_nation", nation)
    m.model("stg_customer", "raw_customer")(lambda c: c.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")))
    m.model("customers_by_nation", "stg_customer", "raw_nation")(lambda c, n: c.join(n, "n_nationkey").groupBy("n_name").agg(F.count("*").alias("customers")))
    return m.build()["customers_by_nation"]


@Q("GEN-06", "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day")
def days(spark):
    return series.calendar(spark, "2024-01-01", "2024-12-31")


# ---- joins -----------------------------------------------------------------------------------
@Q("JON-11", """WITH v AS (SELECT o_custkey AS k, o_orderdate AS ts, row_number() OVER w AS no, lead(o_orderdate) OVER w AS nxt FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)),
d AS (SELECT k, md5(CAST(k AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')) AS sk, CASE WHEN no = 1 THEN TIMESTAMP '1900-01-01 00:00:00' ELSE ts END AS a, coalesce(nxt, TIMESTAMP '9999-12-31 00:00:00') AS b FROM v)
SELECT o_orderkey, coalesce(sk, md5('unknown')) AS sk FROM orders LEFT JOIN d ON o_custkey = k AND o_orderdate >= a AND o_orderdate < b""")  # fmt: skip
def version_lookup(orders):
    """Every order of status F stands for a change of its customer; facts find the version of their time."""
    versions = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("changed")).distinct()
    dim = history.scd2_from_versions(versions, "custkey", "changed")
    facts = orders.select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_orderdate")
    return warehouse.fact_with_versions(facts, dim.select("custkey", "valid_from", "valid_to", "sk"), "custkey", "o_orderdate").select("o_orderkey", "sk")


_ASOF = "SELECT l.event_id, r.event_id AS view_id, r.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l LEFT JOIN LATERAL (SELECT event_id, value FROM events r WHERE r.event_type = 'view' AND r.user_id = l.user_id AND r.ts <= l.ts ORDER BY ts DESC, event_id DESC LIMIT 1) r ON true"


def _asof(events):
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return joins.asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_id", "view_value"], tie="view_id").select("event_id", "view_id", "view_value")


Q("JON-12", _ASOF)(lambda events: _asof(events))


@Q("ML-03", "SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id")
def materialise_latest(events):
    return dedupe.latest_by_aggregate(events.where("event_type = 'view'").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])


@Q("JON-13", "WITH v AS (SELECT o_custkey AS key, o_orderkey AS id, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b FROM orders) SELECT x.key, x.id AS a, y.id AS b FROM v x JOIN v y ON x.key = y.key AND x.id < y.id AND x.a < y.b AND y.a < x.b")
def overlapping(orders):
    spans = orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("e"))
    return joins.overlaps(spans, "o_custkey", "s", "e", "o_orderkey")


@Q("JON-14", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def broadcast_join(lineitem, part):
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(joins.broadcast_if_small(part.select("p_partkey", "p_brand")), F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


@Q("JON-17", "SELECT event_type, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type HAVING count(*) >= 0.15 * (SELECT count(*) FROM events)")
def hot(events):
    return joins.hot_keys(events, "event_type", 0.15)


@Q("JON-18", "SELECT e.event_id, e.event_type, k.label FROM events e LEFT JOIN (SELECT DISTINCT event_type, upper(event_type) AS label FROM events WHERE event_type <> 'error') k ON e.event_type = k.event_type")
def salted(events):
    dim = events.where("event_type <> 'error'").select("event_type").distinct().withColumn("label", F.upper("event_type"))
    found = [r[0] for r in joins.hot_keys(events, "event_type", 0.15).collect()]  # at most 1 / 0.15 keys
    return joins.salted_join(events.select("event_id", "event_type"), dim, "event_type", found).select("event_id", "event_type", "label")


@Q("JON-19", "SELECT user_id % 10 AS k, CAST(count(*) AS BIGINT) AS n FROM events e JOIN customer ON c_custkey = user_id GROUP BY 1")
def adaptive(events, customer):
    """A plain join; adaptive execution splits skewed partitions."""
    return events.join(customer.hint("merge"), F.col("c_custkey") == F.col("user_id")).groupBy((F.col("user_id") % 10).alias("k")).agg(F.count("*").alias("n"))


@Q("JON-20", "SELECT event_id, event_type, CAST(value AS VARCHAR) = '' AS empty FROM events WHERE value > 90")
def join_back(events):
    raw = events.select(F.col("event_id").alias("_rn"), "event_id", "event_type")
    typed = events.select(F.col("event_id").alias("_rn"), (F.col("value").cast("string") == "").alias("empty"), "value").where("value > 90").drop("value")
    return raw.join(typed, "_rn").drop("_rn")


@Q("JON-23", "SELECT event_id, c_name FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS k FROM events) e LEFT JOIN customer ON c_custkey = k")
def null_keys(events, customer):
    e = events.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("k"))
    return joins.null_safe_split_join(e, customer.select(F.col("c_custkey").alias("k"), "c_name"), "k").drop("k")


@Q("AGG-17", """SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name, p_brand, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY 1, 2, 3""")  # fmt: skip
def star(lineitem, orders, customer, nation, part):
    f = lineitem.select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast(MONEY).alias("price"))
    o = orders.where("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    joined = f.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(joins.broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(joins.broadcast_if_small(part.select("p_partkey", "p_brand")), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("month", "n_name", "p_brand").agg(F.countDistinct("o_orderkey").alias("orders"), F.sum("price").cast("decimal(18,2)").alias("revenue"))


@Q("AGG-26", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, max(l_quantity) AS most, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1")
def wide(lineitem):
    return lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(18,2)").alias("total"), F.countDistinct("l_suppkey").alias("suppliers"))


Q("AGG-11")(lambda events: events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("hll_users"), F.percentile_approx("value", 0.5).alias("median")))
Q("AGG-27")(lambda events: diagnostics.partition_skew(events, "user_id", 16))


# ---- deduplication ---------------------------------------------------------------------------
_ORD = "(SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, {} AS seq FROM orders)"


@Q("DED-01", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate) DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1")
def later_wins(orders):
    """Equal times: the row read later wins; the order key stands for the place in the file."""
    month = F.trunc("o_orderdate", "month")
    return dedupe.latest(orders, ["o_custkey"], [month.desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@Q("DED-02", "SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN 'duplicate' END AS reason FROM orders")
def earlier_wins(orders):
    kept, lost = dedupe.first_wins(orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey").asc()])
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(lost)


@Q("DED-03", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderstatus DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1")
def full_order(orders):
    return dedupe.latest(orders, ["o_custkey"], [F.col(c).desc() for c in ("o_orderdate", "o_orderpriority", "o_orderstatus", "o_orderkey")]).select("o_custkey", "o_orderkey")


_MERGE = """WITH t AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o.o_custkey, o.o_orderkey, CAST(o_orderdate AS DATE) AS v, 0 AS b FROM orders o JOIN t ON o.o_orderkey = t.o_orderkey),
u AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1), c AS (SELECT o.o_custkey, o.o_orderkey, CAST(o_orderdate AS DATE) AS v, 1 AS b FROM orders o JOIN u ON o.o_orderkey = u.o_orderkey)
SELECT o_custkey, o_orderkey, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, b {}) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM c) x) y WHERE rn = 1"""


def _merge(orders, strict):
    rows = orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("v"))
    part = lambda r: dedupe.latest_by_aggregate(rows.where(f"o_orderkey % 2 = {r}"), ["o_custkey"], ["o_orderkey"])
    return dedupe.merge_newer(part(0), part(1), ["o_custkey"], "v", strict)


Q("DED-04", _MERGE.format("ASC"))(lambda orders: _merge(orders, True))
Q("SNK-01", _MERGE.format("DESC"))(lambda orders: _merge(orders, False))
Q("DED-05", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1")(lambda events: dedupe.latest_by_aggregate(events.select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"]))
Q("DED-06", "SELECT DISTINCT event_id, user_id FROM events")(lambda events: events.select("event_id", "user_id").union(events.select("event_id", "user_id")).dropDuplicates(["event_id"]))
Q("DED-07", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1")(lambda orders: dedupe.latest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey"))


@Q("DED-10", "WITH n AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, p_brand || '/' || p_size AS block FROM part) SELECT a.id AS a, b.id AS b, CAST(levenshtein(a.name, b.name) AS INT) AS edits FROM n a JOIN n b ON a.block = b.block AND a.id < b.id WHERE levenshtein(a.name, b.name) <= 2")
def entities(part):
    return dedupe.similar_names(part, "p_partkey", "p_name", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))


# ---- windows and series ----------------------------------------------------------------------
@Q("WIN-10", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS grp FROM d) SELECT user_id, min(day) AS start, max(day) AS end, CAST(count(*) AS BIGINT) AS days FROM g GROUP BY user_id, grp")
def runs(events):
    return series.islands(events.select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@Q("WIN-11", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS version_no FROM orders")
def versions(orders):
    return orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("version_no"))


@Q("WIN-14", "WITH g AS (SELECT event_type, CAST(day AS DATE) AS day FROM (SELECT DISTINCT event_type FROM events) t, (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS day) d), e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT g.event_type, g.day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN e ON g.event_type = e.event_type AND g.day = e.day")
def gaps(events):
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    a, b = daily.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    return series.fill_gaps(daily, "event_type", "day", "n", a, b)


@Q("WIN-15", "WITH m AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800 THEN 1 ELSE 0 END AS brk FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events) x), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM m) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, CAST(count(*) AS BIGINT) AS n_events FROM s GROUP BY user_id, n")
def sessions(events):
    cut = events.select("user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return series.sessions(cut, "user_id", "ts", 30)


@Q("AGG-21b", """WITH v AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN v ON e.user_id = v.user_id AND e.ts > v.t WHERE event_type = 'click' GROUP BY 1),
p AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN c ON e.user_id = c.user_id AND e.ts > c.t WHERE event_type = 'purchase' GROUP BY 1)
SELECT (SELECT count(*) FROM v)::BIGINT AS reached_view, (SELECT count(*) FROM c)::BIGINT AS reached_click, (SELECT count(*) FROM p)::BIGINT AS reached_purchase""")  # fmt: skip
def funnel(events):
    return series.ordered_funnel(events, "user_id", "ts", "event_type", ["view", "click", "purchase"])


# ---- modelling, changes, increments ----------------------------------------------------------
Q("MOD-01", "SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, strftime(d, '%Y-%m') AS year_month, dayname(d) AS day_name, CAST(isodow(d) AS INT) AS iso_day, isodow(d) >= 6 AS is_weekend FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS d) t")(lambda spark: warehouse.dim_date(spark))
Q("MOD-02", "SELECT p_partkey, p_name, md5(CAST(p_partkey AS VARCHAR)) AS sk FROM part UNION ALL SELECT -1, 'UNKNOWN', md5('unknown')")(lambda part: warehouse.dim_scd1(part.select("p_partkey", "p_name"), "p_partkey", {"p_partkey": -1, "p_name": "UNKNOWN"}))


@Q("MOD-05", """SELECT o_custkey, o_orderdate, CAST(row_number() OVER w AS BIGINT) AS version_no, CASE WHEN row_number() OVER w = 1 THEN TIMESTAMP '1900-01-01 00:00:00' ELSE o_orderdate END AS valid_from, coalesce(lead(o_orderdate) OVER w, TIMESTAMP '9999-12-31 00:00:00') AS valid_to,
lead(o_orderdate) OVER w IS NULL AS is_current, md5(CAST(o_custkey AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS sk FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")  # fmt: skip
def dim_versions(orders):
    return history.scd2_from_versions(orders.select("o_custkey", "o_orderdate").distinct(), "o_custkey", "o_orderdate")


Q("MOD-06", _ASOF.replace("view_value", "v").replace("AS v FROM", "AS view_value FROM"))(lambda events: _asof(events))


@Q("MOD-07", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS previous_c_mktsegment FROM customer""")
def scd3(customer):
    dim = customer.select("c_custkey", "c_mktsegment")
    batch = dim.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("MOVED"))
    return history.scd3_apply(dim, batch, "c_custkey", "c_mktsegment")


@Q("MOD-07b", "SELECT c_custkey, c_mktsegment, TIMESTAMP '2020-01-01 00:00:00' AS at, TIMESTAMP '2020-01-01 00:00:00' AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2021-01-01 00:00:00' END AS valid_to FROM customer UNION ALL SELECT c_custkey, 'MOVED', TIMESTAMP '2021-01-01 00:00:00', TIMESTAMP '2021-01-01 00:00:00', NULL FROM customer WHERE c_custkey % 3 = 0")
def scd2_step(customer):
    at = lambda y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")
    dim = customer.select("c_custkey", "c_mktsegment", at(2020).alias("at"), at(2020).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    batch = customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), at(2021).alias("at"))
    return history.scd2_apply(dim, batch, "c_custkey", "at", compare=["c_mktsegment"])


Q("MOD-08", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_nationkey, CAST(count(*) AS BIGINT) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")(
    lambda orders, customer: orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.trunc("o_orderdate", "month").alias("month"), "c_nationkey").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast(MONEY)).cast("decimal(18,2)").alias("amount"))
)
Q("MOD-09", "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda customer, nation, region: customer.join(joins.broadcast_if_small(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")
)


@Q("MOD-10", "SELECT md5(upper(trim(CAST(c_custkey AS VARCHAR)))) AS hub_key, md5(c_name || '|' || c_mktsegment) AS hash_diff, c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def vault(customer):
    existing = history.satellite(customer.where("c_custkey % 2 = 0"), "c_custkey", ["c_name", "c_mktsegment"])
    return history.satellite(customer, "c_custkey", ["c_name", "c_mktsegment"], existing)


_CDC_ORACLE = """WITH c AS (SELECT user_id AS id, event_type AS kind, event_id AS lsn, CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op FROM events WHERE event_id % 2 = 0), t AS (SELECT user_id AS id, max_by(event_type, event_id) AS kind, max(event_id) AS lsn FROM events WHERE event_id % 2 = 1 GROUP BY 1),
u AS (SELECT id, kind, lsn, 'r' AS op FROM t UNION ALL SELECT id, kind, lsn, op FROM c) SELECT id, kind, lsn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS rn FROM u) x WHERE rn = 1 AND op <> 'd'"""


@Q("CDC-01", _CDC_ORACLE)
def cdc(events):
    rows = events.select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("event_id").alias("lsn"))
    target = dedupe.latest_by_aggregate(rows.where("lsn % 2 = 1"), ["id"], ["lsn"])
    changes = rows.where("lsn % 2 = 0").withColumn("op", F.when(F.col("kind") == "error", "d").otherwise("u"))
    return history.cdc_apply(target, changes, "id")


@Q("CDC-02", "SELECT user_id AS id, event_type AS kind, CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op, event_id AS lsn FROM events")
def unwrap(events):
    state = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind"))
    gone = F.col("event_type") == "error"
    envelope = events.select(F.when(gone, state).alias("before"), F.when(~gone, state).alias("after"), F.when(gone, "d").otherwise("u").alias("op"), F.struct(F.col("event_id").alias("lsn")).alias("source"))
    return history.cdc_unwrap(envelope)


Q("INC-01", "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 5 = 0) - INTERVAL 30 DAY")(lambda orders: history.increment(orders, "o_orderdate", orders.where("o_orderkey % 5 = 0").agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAY")).alias("m")).first()[0]).select("o_orderkey"))


@Q("SNK-27", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 10 <> 0) - INTERVAL 3 DAY")
def incremental(orders):
    rows = orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    return history.incremental_merge(rows.where("o_orderkey % 10 <> 0"), rows, ["o_orderkey"], "o_orderdate", 3)


Q("EVT-01", "SELECT user_id, max_by(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY 1")(lambda events: history.as_of_state(events, "user_id", "event_id", F.col("event_type")))
Q("IDM-01", "SELECT o_orderkey, o_totalprice FROM orders")(lambda orders: history.scd1_apply(history.scd1_apply(orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", "o_totalprice").where("o_orderkey % 2 = 0"), "o_orderkey"), orders.select("o_orderkey", "o_totalprice").where("o_orderkey % 2 = 0"), "o_orderkey"))

# ---- governance, features, vectors, graphs ---------------------------------------------------
Q("GOV-01", "SELECT c_custkey, regexp_replace(c_name, '^(.).*$', '\\1***') AS name, '***' || right(c_name, 4) AS tail FROM customer")(lambda customer: customer.select("c_custkey", scalars.by_role("analyst", F.col("c_name"), F.regexp_replace("c_name", "^(.).*$", "$1***")).alias("name"), scalars.mask_tail(F.col("c_name")).alias("tail")))
Q("GOV-02", "SELECT floor(c_acctbal / 1000) * 1000 AS band, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 HAVING count(*) >= 5")(lambda customer: customer.groupBy((F.floor(F.col("c_acctbal") / 1000) * 1000).cast("double").alias("band")).agg(F.count("*").alias("n")).where("n >= 5"))
Q("GOV-03", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND user_id <> 7")(lambda events: events.join(F.broadcast(events.agg((F.max("ts") - F.expr("INTERVAL 10 DAY")).alias("keep_from")))).where("ts >= keep_from AND user_id <> 7").select("event_id"))


@Q("ML-01", "WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(value AS DECIMAL(12,2)) AS v FROM events) SELECT event_id, CAST(count(*) OVER (w RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS BIGINT) AS n_7d, CAST(coalesce(sum(v) OVER (w RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,2)) AS sum_7d, t - max(t) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recency_s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def entity_features(events):
    e = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast(MONEY).alias("v"))
    out = features.rolling_features(e, "user_id", "ts", "v", (7,))
    return out.select("event_id", "n_7d", F.col("sum_7d").cast("decimal(18,2)").alias("sum_7d"), "recency_s")


Q("ML-02", "SELECT user_id, CASE WHEN ('0x' || substr(md5('1:' || user_id), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS side FROM (SELECT DISTINCT user_id FROM events) t")(lambda events: events.select("user_id").distinct().select("user_id", features.split_by_hash(F.col("user_id")).alias("side")))
Q("ML-04", """WITH e AS (SELECT value FROM events WHERE event_id % 2 = 0), a AS (SELECT value FROM events WHERE event_id % 2 = 1), q AS (SELECT unnest(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS c FROM e),
p AS (SELECT bin, count(*) / (SELECT count(*) FROM e) AS p FROM (SELECT (SELECT count(*) FROM q WHERE e.value > c) AS bin FROM e) t GROUP BY 1), r AS (SELECT bin, count(*) / (SELECT count(*) FROM a) AS q FROM (SELECT (SELECT count(*) FROM q WHERE a.value > c) AS bin FROM a) t GROUP BY 1)
SELECT round(sum((greatest(coalesce(q, 0), 1e-6) - greatest(coalesce(p, 0), 1e-6)) * ln(greatest(coalesce(q, 0), 1e-6) / greatest(coalesce(p, 0), 1e-6))), 6) AS psi FROM p FULL JOIN r ON p.bin = r.bin""")(lambda events: features.psi(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "value"))  # fmt: skip
Q("ML-05", "WITH u AS (SELECT value, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS x, sum(event_id % 2) AS y FROM events GROUP BY 1), c AS (SELECT sum(x) OVER (ORDER BY value) / sum(x) OVER () AS a, sum(y) OVER (ORDER BY value) / sum(y) OVER () AS b FROM u) SELECT round(max(abs(a - b)), 6) AS ks FROM c")(lambda events: features.ks_statistic(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "value"))
Q("ML-05b", "WITH n AS (SELECT event_type, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS a, sum(event_id % 2) AS b FROM events GROUP BY 1), t AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM n), e AS (SELECT *, (a + b) * na / (na + nb) AS ea, (a + b) * nb / (na + nb) AS eb FROM t) SELECT round(sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb), 6) AS chi2 FROM e")(lambda events: features.chi_square(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "event_type"))
Q("ML-06", "SELECT event_id, f.n AS event_type_freq, CAST(event_type = 'click' AS INT) AS event_type_click, CAST(event_type = 'view' AS INT) AS event_type_view FROM events JOIN (SELECT event_type AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1) f ON k = event_type")(lambda events: features.one_hot(features.frequency_encode(events, "event_type"), "event_type", ["click", "view"]).select("event_id", "event_type_freq", "event_type_click", "event_type_view"))
Q("ML-06b", "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) AS word FROM documents), tf AS (SELECT doc_id, word, CAST(count(*) AS BIGINT) AS tf FROM w WHERE word <> '' GROUP BY 1, 2), d AS (SELECT word, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY 1) SELECT doc_id, tf.word, tf, df, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS tf_idf FROM tf JOIN d ON tf.word = d.word")(lambda documents: features.tf_idf(documents, "doc_id", "text"))
Q("ML-07", "SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE text IS NULL)::BIGINT AS null_texts, (SELECT count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1) x)::BIGINT AS leaked FROM documents")(
    lambda documents: documents.agg(F.count("*").alias("rows"), F.count(F.when(F.col("text").isNull(), 1)).alias("null_texts")).join(F.broadcast(documents.groupBy("text").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("a"), F.count_if(F.col("doc_id") % 2 == 1).alias("b")).agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("leaked"))))
)
_VEC = "SELECT q.vec_id AS query, v.vec_id AS id, {} AS {} FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings v WHERE q.vec_id <> v.vec_id"
Q("VEC-01", "SELECT query, id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM (" + _VEC.format("round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)", "similarity") + ") s) t WHERE rank <= 10")(lambda embeddings: vectors.top_k(embeddings, embeddings.where("vec_id % 100 = 0"), 10))
Q("VEC-01b", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")(lambda embeddings: embeddings.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm")))
Q("VEC-02")(lambda embeddings: vectors.ivf_search(embeddings, embeddings.where("vec_id % 100 = 0"), 10, cells=16, probes=14))


def _edges(supplier):
    """Suppliers of a nation form a ring, as links."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    nxt = F.coalesce(F.lead("s_suppkey").over(w), F.first("s_suppkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    one = supplier.select(F.col("s_suppkey").alias("src"), nxt.alias("dst")).where("src <> dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


_EDGES = "WITH n AS (SELECT s_suppkey AS src, coalesce(lead(s_suppkey) OVER w, first_value(s_suppkey) OVER w) AS dst FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)), e AS (SELECT src, dst FROM n WHERE src <> dst UNION SELECT dst, src FROM n WHERE src <> dst) "
Q("GRF-01", _EDGES + "SELECT a, b, ways FROM (SELECT x.src AS a, y.dst AS b, CAST(count(*) AS BIGINT) AS ways FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst GROUP BY 1, 2) t WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = a AND dst = b)")(lambda supplier: graph.friends_of_friends(_edges(supplier)))
Q("GRF-01b", _EDGES + "SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) t GROUP BY 1")(lambda supplier: graph.degrees(_edges(supplier)))
Q("LAK-07", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM orders GROUP BY 1")(
    lambda orders: orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("price"))).alias("items")).select("o_custkey", F.explode("items").alias("i")).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("i.price").cast("decimal(18,2)").alias("total"))
)
