"""Projections, filters, joins, subqueries, set operations and sorts: SQL that both engines read alike, unless an oracle stands beside it."""

from millrace.queries.registry import Registry

Q = Registry()
M = "CAST(o_totalprice AS DECIMAL(12,2))"

Q.sql("PRJ-01", f"SELECT o_orderkey AS order_id, {M} AS amount, CAST({M} * 2 AS DECIMAL(14,2)) AS double_amount FROM orders", tables="orders")
Q.sql("PRJ-02", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", tables="orders")
Q.sql("PRJ-03", "SELECT c_custkey, lower(trim(c_name)) AS name, upper(c_mktsegment) AS segment, CAST(c_acctbal AS DECIMAL(12,2)) AS balance FROM customer WHERE c_custkey IS NOT NULL", tables="customer")
Q.sql(
    "PRJ-04",
    """SELECT l_orderkey, l_linenumber, CAST(gross AS DECIMAL(14,2)) AS gross, CAST(discount AS DECIMAL(14,2)) AS discount, CAST(round(CAST(gross_exact - discount_exact AS DECIMAL(20,6)), 2) AS DECIMAL(14,2)) AS net FROM (
SELECT l_orderkey, l_linenumber, round(gross_exact, 2) AS gross, round(discount_exact, 2) AS discount, gross_exact, discount_exact FROM (
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(6,2)) * CAST(l_extendedprice AS DECIMAL(10,2)) AS DECIMAL(18,6)) AS gross_exact,
  CAST(CAST(l_quantity AS DECIMAL(6,2)) * CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS discount_exact FROM lineitem) a) b""",
    tables="lineitem",
)
Q.sql("PRJ-05", "SELECT * EXCEPT (c_acctbal, c_mktsegment) FROM customer", "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer", tables="customer")
_STATUS = ", ".join(f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in "FOP")
Q.sql("PRJ-06", f"SELECT o_orderpriority, {_STATUS} FROM orders GROUP BY o_orderpriority", tables="orders")

Q.sql("FLT-01", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#2') AND NOT p_type LIKE '%X%' AND p_retailprice >= 900 OR p_name ILIKE '%1_3%'", tables="part")
Q.sql("FLT-02", "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind FROM events) SELECT event_id, kind IS NULL AS missing, kind = 'click' AS is_click FROM t WHERE kind IS NULL OR kind <> 'view'", tables="events")
Q.sql("FLT-03", "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind FROM events) SELECT event_id, kind FROM t WHERE kind IS DISTINCT FROM 'click'", tables="events")
Q.sql("FLT-04", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'", tables="orders")
Q.sql("FLT-05", "SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS event_date FROM events WHERE user_id IS NOT NULL AND value >= 0 AND event_type IN ('click', 'purchase', 'view')", tables="events")
Q.sql("FLT-06", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band FROM orders", tables="orders")
Q.sql("FLT-07", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50", tables="orders")
Q.sql("FLT-08", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-03-02 00:00:00'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1996-03-01'", tables="lineitem")

Q.sql("JON-01", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", tables="orders customer")
Q.sql("JON-02", "SELECT e.event_id, e.user_id, coalesce(c.c_mktsegment, 'UNKNOWN') AS segment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey", tables="events customer")
Q.sql("JON-03", "SELECT c_custkey, u.user_id, CASE WHEN c_custkey IS NULL THEN 'only_events' WHEN u.user_id IS NULL THEN 'only_customer' ELSE 'both' END AS side FROM customer FULL OUTER JOIN (SELECT DISTINCT user_id FROM events) u ON c_custkey = u.user_id", tables="customer events")
Q.sql("JON-03r", "SELECT n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey", tables="nation region")
Q.sql("JON-04", "SELECT r_name, s.status FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus AS status FROM orders) s", tables="region orders")
Q.sql("JON-05", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", tables="customer orders")
Q.sql("JON-05b", "SELECT p_partkey FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) l ON p_partkey = l_partkey WHERE l_partkey IS NULL", tables="part lineitem")
Q.sql("JON-06", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END FROM orders)", tables="customer orders")
Q.sql("JON-07", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", tables="customer orders")
Q.sql("JON-08", "SELECT a.n_name AS nation, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", tables="nation")
Q.sql("JON-09", f"SELECT r_name, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", tables="lineitem orders customer nation region")
Q.sql("JON-10", f"WITH items AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderstatus, CAST(sum({M}) AS DECIMAL(18,2)) AS revenue, CAST(sum(n) AS BIGINT) AS items FROM orders LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY o_orderstatus", tables="orders lineitem")
Q.sql("JON-21", "SELECT o.n AS orders_rows, i.n AS item_orders, o.n - i.n AS missing FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM orders) o CROSS JOIN (SELECT CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n FROM lineitem) i", tables="orders lineitem")
_PLAIN = "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
for _id, _hint in (("JON-15", "MERGE(orders, customer)"), ("JON-16", "SHUFFLE_HASH(customer), BROADCAST(nation)")):
    Q.sql(_id, _PLAIN.replace("SELECT", f"SELECT /*+ {_hint} */", 1), _PLAIN, tables="orders customer nation")

Q.sql("SUB-01", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", tables="orders")
Q.sql("SUB-02", f"WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(sum({M}) AS DECIMAL(18,2)) AS total FROM big GROUP BY o_custkey) SELECT c_name, n, total FROM per JOIN customer ON c_custkey = o_custkey WHERE n >= 2", tables="orders customer")
Q.sql(
    "SUB-03",
    "WITH RECURSIVE tree(id, name, level) AS (SELECT r_regionkey, r_name, 0 FROM region WHERE r_regionkey >= 0 UNION ALL SELECT n.n_nationkey + 100, n.n_name, t.level + 1 FROM nation n JOIN tree t ON n.n_regionkey = t.id AND t.level = 0) SELECT id, name, level FROM tree",
    tables="region nation",
)
Q.sql("SUB-03b", "WITH RECURSIVE d(day) AS (SELECT DATE '2024-01-01' UNION ALL SELECT date_add(day, 1) FROM d WHERE day < DATE '2024-03-01') SELECT day FROM d", "WITH RECURSIVE d(day) AS (SELECT DATE '2024-01-01' UNION ALL SELECT CAST(day + INTERVAL 1 DAY AS DATE) FROM d WHERE day < DATE '2024-03-01') SELECT day FROM d")
Q.sql(
    "SUB-04",
    # the date is selected too: Spark ranks a key's rows by an order only if it stands right below the LIMIT, with no projection between
    "SELECT c_custkey, o.o_orderkey AS last_order FROM customer, LATERAL (SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o",
    "SELECT c_custkey, o.o_orderkey AS last_order FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o",
    tables="customer orders",
)

Q.sql("SET-01", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'unknown', CAST(-1 AS BIGINT), 'UNKNOWN'", tables="customer supplier")
Q.sql("SET-02", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", tables="customer supplier")
Q.sql("SET-03", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", tables="customer supplier")
Q.sql("SET-03b", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000", tables="nation supplier")
Q.sql("SET-03c", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", tables="customer supplier")

Q.sql("SRT-01", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer ORDER BY segment ASC NULLS LAST, c_custkey DESC", tables="customer")
Q.sql("SRT-02", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", tables="orders")
Q.sql("SRT-03", f"SELECT o_custkey, CAST(sum({M}) AS DECIMAL(18,2)) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10", tables="orders")

Q.sql("CON-01", "SELECT CAST(count(*) FILTER (WHERE o_custkey IS NULL) AS BIGINT) AS null_keys, CAST(count(*) - count(DISTINCT o_orderkey) AS BIGINT) AS duplicate_keys, CAST(count(*) FILTER (WHERE NOT (o_totalprice >= 0)) AS BIGINT) AS negative, CAST(count(*) FILTER (WHERE c_custkey IS NULL) AS BIGINT) AS orphans FROM orders LEFT JOIN customer ON o_custkey = c_custkey", tables="orders customer")
