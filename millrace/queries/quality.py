"""Data-quality operators on the given tables."""

from pyspark.sql import functions as F

from millrace.plans import warehouse
from millrace.quality.contract import Check
from millrace.quality.engine import violates
from millrace.quality.validators import daily_orders, etl_orders, split
from millrace.queries.registry import Registry
from millrace.streaming import clicks

Q = Registry()


def _count(check):
    return lambda df: df.agg(F.count_if(violates(check)).alias("bad"))


Q("DQ-01", "SELECT CAST(count(*) FILTER (WHERE CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END IS NULL) AS BIGINT) AS bad FROM events")(lambda events: _count(Check("n", "not_null", column="u"))(events.select(F.when(F.col("event_id") % 9 != 0, F.col("user_id")).alias("u"))))
Q("DQ-02", "SELECT CAST(count(*) FILTER (WHERE value < 5 OR value > 80) AS BIGINT) AS bad FROM events")(lambda events: _count(Check("r", "range", column="value", options={"min": 5, "max": 80}))(events))
Q("DQ-03", "SELECT CAST(count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS BIGINT) AS bad FROM events")(lambda events: _count(Check("a", "accepted_values", column="event_type", options={"values": ["click", "view"]}))(events))
Q("DQ-04", "SELECT CAST(count(*) FILTER (WHERE NOT regexp_matches(c_name, '[0-4]$')) AS BIGINT) AS bad FROM customer")(lambda customer: _count(Check("x", "regex", column="c_name", options={"pattern": "[0-4]$"}))(customer))
Q("DQ-05", "SELECT CAST(count(*) FILTER (WHERE TRY_CAST(c_name AS BIGINT) IS NULL) AS BIGINT) AS bad FROM customer")(lambda customer: customer.agg(F.count_if(F.col("c_name").isNotNull() & F.col("c_name").try_cast("bigint").isNull()).alias("bad")))
Q("DQ-06", "SELECT CAST(count(*) - count(DISTINCT o_custkey) AS BIGINT) AS single, CAST(count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS BIGINT) AS pair FROM orders")(lambda orders: orders.agg((F.count("*") - F.countDistinct("o_custkey")).alias("single"), (F.count("*") - F.countDistinct(F.struct("o_custkey", "o_orderstatus"))).alias("pair")))
Q("DQ-07", "SELECT count(*) BETWEEN 10 AND 1000000000 AS passed FROM orders")(lambda orders: orders.agg(F.count("*").between(10, 1000000000).alias("passed")))
Q("DQ-08", "SELECT CAST(count(*) FILTER (WHERE event_id % 9 = 0) AS DOUBLE) / count(*) AS rate FROM events")(lambda events: events.agg((F.count_if(F.when(F.col("event_id") % 9 != 0, F.col("user_id")).isNull()).cast("double") / F.count("*")).alias("rate")))
Q("DQ-09", "SELECT CAST(epoch(TIMESTAMP '2030-01-01 00:00:00') - epoch(max(date_trunc('second', ts))) AS DOUBLE) / 3600 AS age_hours FROM events")(lambda events: events.agg(((F.lit(1893456000) - F.max(F.unix_timestamp("ts"))).cast("double") / 3600).alias("age_hours")))


@Q("DQ-13", "SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity > 45 THEN 'q' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'f' END], lambda x: x IS NOT NULL) AS reasons FROM lineitem WHERE l_quantity > 45 OR l_returnflag NOT IN ('A', 'N')")
def quarantine(lineitem):
    checks = [Check("q", "range", column="l_quantity", options={"max": 45}), Check("f", "accepted_values", column="l_returnflag", options={"values": ["A", "N"]})]
    reasons = F.filter(F.array(*[F.when(violates(c), c.id) for c in checks]), lambda x: x.isNotNull())
    return lineitem.select("l_orderkey", "l_linenumber", reasons.alias("reasons")).where(F.size("reasons") > 0)


@Q("DQ-18", """SELECT order_id, CASE WHEN amount LIKE '-%' THEN 'negative amount' WHEN status NOT IN ('created', 'paid', 'shipped') THEN 'unknown status' WHEN created IS NULL THEN 'invalid created_at' END AS reason FROM (
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN '-5' ELSE '7,25' END AS amount, CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'paid' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE '2024-01-01' END AS created FROM orders) t""")  # fmt: skip
def validator(orders):
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"), F.when(F.col("o_orderkey") % 11 == 0, "-5").otherwise("7,25").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "Shipped").when(F.col("o_orderstatus") == "O", "paid").otherwise("pending").alias("status"), F.lit("sp").alias("uf"),
        F.when(F.col("o_orderkey") % 13 == 0, "2024-1-1").otherwise("2024-01-01").alias("created_at"), F.lit(None).cast("string").alias("updated_at"),
    )
    return etl_orders(text).select("order_id", "reason")


@Q("DQ-22", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT o_orderkey) AS BIGINT) AS duplicates, CAST(count(*) FILTER (WHERE o_totalprice < 0) AS BIGINT) AS negative FROM orders")
def post_load(orders):
    return orders.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("o_orderkey")).alias("duplicates"), F.count_if(F.col("o_totalprice") < 0).alias("negative"))


@Q("DQ-18b", "SELECT CAST(count(*) FILTER (WHERE day = '1996-01-02') AS BIGINT) AS valid, CAST(count(*) FILTER (WHERE day <> '1996-01-02') AS BIGINT) AS rejected FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) t")
def daily(orders):
    text = orders.select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"), F.lit("5.00").alias("amount"), F.lit("paid").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))
    valid, rejected = split(daily_orders(text, "1996-01-02"))
    return valid.agg(F.count("*").alias("valid")).join(rejected.agg(F.count("*").alias("rejected")))


Q("DQ-19", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")(lambda orders: warehouse.unique(orders, "o_custkey"))
Q("DQ-19b", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")(lambda events, customer: warehouse.relationship(events, "user_id", customer, "c_custkey").select("event_id"))
Q("DQ-23", "SELECT * FROM (SELECT count(*)::BIGINT AS n_left, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(22,2) AS sum_left FROM orders) a, (SELECT count(*)::BIGINT AS n_right, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(22,2) AS sum_right FROM orders WHERE o_orderkey > 3) b WHERE n_left <> n_right OR sum_left <> sum_right")(
    lambda orders: warehouse.reconcile(orders, orders.where("o_orderkey > 3"), F.col("o_totalprice").cast("decimal(12,2)"), F.col("o_totalprice").cast("decimal(12,2)"))
)
Q("DQ-24", "SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE abs(CAST(o_totalprice AS DECIMAL(12,2)) - s) > 0.01")(
    lambda orders, lineitem: orders.join(lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("s")), F.col("l_orderkey") == F.col("o_orderkey")).where(F.abs(F.col("o_totalprice").cast("decimal(12,2)") - F.col("s")) > 0.01).select("o_orderkey")
)


@Q("STM-24", """SELECT time_bucket(INTERVAL 1 MINUTE, date_trunc('second', ts)) AS window_start, event_type AS page, CAST(count(DISTINCT event_id) AS BIGINT) AS views, CAST(count(DISTINCT user_id) AS INT) AS users FROM events GROUP BY 1, 2""")
def batch_clicks(events):
    """The streaming job's operators over a whole table at once."""
    value = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("page"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time")))
    out = clicks.windowed_counts(clicks.parse(events.select(value.alias("value"))))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@Q("STM-08", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL (5 * k) MINUTE AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def sliding(events):
    return events.groupBy(F.window("ts", "10 minutes", "5 minutes"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@Q("STM-09", "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, CAST(count(*) AS BIGINT) AS events FROM s GROUP BY user_id, n")
def session(events):
    return events.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("stop"), "events")
