"""Aggregations and window functions in SQL."""

from millrace.queries.registry import Registry

Q = Registry()
M = "CAST(o_totalprice AS DECIMAL(12,2))"
R = f"CAST(sum({M}) AS DECIMAL(18,2))"

Q.sql("AGG-01", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(nullif(o_orderstatus, 'P')) AS BIGINT) AS n_status, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, {R} AS total, CAST(sum({M}) AS DOUBLE) / count(*) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders", tables="orders")
Q.sql("AGG-02", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", tables="nation")
Q.sql("AGG-03", f"SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL", tables="orders")
Q.sql("AGG-03b", f"SELECT substr(o_orderpriority, 1, 1) AS p, {R} AS total FROM orders GROUP BY 1", tables="orders")
Q.sql("AGG-04", f"SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND sum({M}) > 500000", tables="orders")
Q.sql("AGG-05", f"SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS done, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN {M} ELSE 0 END) AS DECIMAL(18,2)) AS open_amount FROM orders GROUP BY o_custkey", tables="orders")
Q.sql("AGG-06", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem", tables="lineitem")
Q.sql("AGG-07", f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())", tables="orders")
Q.sql("AGG-07b", f"SELECT o_orderstatus, o_orderpriority, {R} AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", tables="orders")
Q.sql("AGG-07c", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS gs, CAST(grouping(o_orderpriority) AS INT) AS gp, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", tables="orders")
Q.sql("AGG-08", f"SELECT * FROM (SELECT o_orderpriority, o_orderstatus, {M} AS amount FROM orders) PIVOT (CAST(sum(amount) AS DECIMAL(18,2)) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", f"SELECT o_orderpriority, CAST(sum({M}) FILTER (WHERE o_orderstatus = 'F') AS DECIMAL(18,2)) AS f, CAST(sum({M}) FILTER (WHERE o_orderstatus = 'O') AS DECIMAL(18,2)) AS o, CAST(sum({M}) FILTER (WHERE o_orderstatus = 'P') AS DECIMAL(18,2)) AS p FROM orders GROUP BY o_orderpriority", tables="orders")
Q.sql("AGG-09", "SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (amount FOR measure IN (l_discount, l_tax))", "SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem", tables="lineitem")
Q.sql("AGG-10", "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p95, round(stddev(o_totalprice), 4) AS sd FROM orders GROUP BY o_orderstatus", tables="orders")
Q.sql("AGG-13", f"SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, {R} AS lifetime_value, CAST(min(o_orderdate) AS DATE) AS first_order, CAST(max(o_orderdate) AS DATE) AS last_order FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey", tables="orders")
Q.sql("AGG-14", "SELECT CAST(o_orderdate AS DATE) AS order_date, o_orderstatus, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1, 2", tables="orders")
Q.sql("AGG-15", """SELECT CAST(e.ts AS DATE) AS event_date, coalesce(c_mktsegment, 'UNKNOWN') AS segment, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT e.user_id) AS BIGINT) AS active_users,
CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2)) WHEN event_type = 'error' THEN -CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS DECIMAL(18,2)) AS net_revenue
FROM events e LEFT JOIN customer ON e.user_id = c_custkey GROUP BY 1, 2""", tables="events customer")  # fmt: skip
Q.sql("AGG-16", f"SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS orders, CAST(coalesce(sum({M}) FILTER (WHERE o_orderstatus <> 'P'), 0) AS DECIMAL(18,2)) AS revenue FROM orders GROUP BY 1", tables="orders")
Q.sql("AGG-18", "SELECT p_brand, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY p_brand", tables="lineitem part orders customer")
Q.sql("AGG-19", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(14,4))) AS DOUBLE) / nullif(CAST(sum(CAST(l_extendedprice AS DECIMAL(14,4))) AS DOUBLE), 0) AS discount_rate FROM lineitem GROUP BY l_returnflag", tables="lineitem")
Q.sql("AGG-20", """WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY o_custkey),
a AS (SELECT DISTINCT o.o_custkey, year(first) * 12 + month(first) AS cohort, year(o_orderdate) * 12 + month(o_orderdate) - year(first) * 12 - month(first) AS age FROM orders o JOIN f ON o.o_custkey = f.o_custkey)
SELECT CAST(cohort AS INT) AS cohort, CAST(age AS INT) AS age, CAST(count(*) AS BIGINT) AS customers FROM a WHERE age <= 12 GROUP BY cohort, age""", tables="orders")  # fmt: skip
Q.sql("AGG-21", "SELECT CAST(count(*) AS BIGINT) AS users, CAST(sum(v) AS BIGINT) AS viewed, CAST(sum(v * c) AS BIGINT) AS clicked, CAST(sum(v * c * p) AS BIGINT) AS purchased FROM (SELECT user_id, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS v, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS c, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS p FROM events GROUP BY user_id) u", tables="events")
Q.sql("AGG-22", "SELECT user_id, max_by(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY user_id", tables="events")
Q.sql("AGG-23", "SELECT w AS word, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(split(lower(text), '[ \\\\n\\\\t\\\\r]+')) AS w FROM documents) t WHERE w <> '' GROUP BY w", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) AS w FROM documents) t WHERE w <> '' GROUP BY w", tables="documents")
Q.sql("AGG-24", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3", tables="events")

W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
Q.sql("WIN-01", f"SELECT o_orderkey, CAST(sum({M}) OVER (PARTITION BY o_custkey) AS DECIMAL(18,2)) AS total, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders", f"SELECT o_orderkey, CAST(sum({M}) OVER (PARTITION BY o_custkey) AS DECIMAL(18,2)) AS total, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders", tables="orders")
Q.sql("WIN-02", f"SELECT o_orderkey, CAST(row_number() {W}) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr, CAST(ntile(4) {W}) AS BIGINT) AS quart FROM orders", tables="orders")
Q.sql("WIN-03", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders) t WHERE rn <= 3", tables="orders")
Q.sql("WIN-04", f"SELECT o_orderkey, lag(o_totalprice) {W}) AS before, lead(o_orderkey) {W}) AS next_order, o_totalprice - lag(o_totalprice) {W}) AS delta, (o_totalprice - lag(o_totalprice) {W})) / nullif(lag(o_totalprice) {W}), 0) AS change FROM orders", tables="orders")
Q.sql("WIN-05", f"SELECT o_orderkey, CAST(sum({M}) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS running FROM orders", tables="orders")
Q.sql("WIN-06", f"SELECT o_orderkey, CAST(sum({M}) {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean7 FROM orders", tables="orders")
Q.sql("WIN-06b", f"SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL '6' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n_7d FROM orders", tables="orders")
Q.sql("WIN-07", f"SELECT o_orderkey, CAST(sum({M}) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS by_range, CAST(sum({M}) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS by_rows FROM orders", tables="orders")
_FULL = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
Q.sql("WIN-08", f"SELECT o_orderkey, first_value(o_orderkey) {_FULL} AS first_order, last_value(o_orderkey) {_FULL} AS last_order, nth_value(o_orderkey, 2) {_FULL} AS second_order FROM orders", tables="orders")
Q.sql("WIN-09", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(count(*) OVER w AS BIGINT) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", tables="orders")
Q.sql("WIN-13", f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {R} AS revenue FROM orders GROUP BY 1", tables="orders")

DED = "FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1"
Q.sql("DED-08", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", tables="lineitem")
Q.sql("DED-09", f"SELECT o_custkey, o_orderkey {DED}", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC", tables="orders")
Q.sql("LAK-06", "SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn <= 5", tables="events")
