"""Scalar functions, user-defined functions and JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.queries.registry import Registry

Q = Registry()

Q("STR-01", "SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END), '') AS name, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low FROM customer")(
    lambda customer: customer.select("c_custkey", S.empty_to_null(F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))).alias("name"), F.upper("c_mktsegment").alias("up"), F.lower("c_mktsegment").alias("low"))
)
Q.sql("STR-02", "SELECT c_custkey, c_name || '-' || c_mktsegment AS label, concat_ws('/', c_name, c_mktsegment) AS path FROM customer", tables="customer")
Q("STR-03", "SELECT p_partkey, replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') AS comma, split_part(p_brand, '#', 2) AS brand_no, starts_with(p_type, 'S') AS s FROM part")(
    lambda part: part.select("p_partkey", F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")).alias("comma"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_no"), F.col("p_type").startswith("S").alias("s"))
)
Q("STR-04", "SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS has_number, text ILIKE '%license%' AS mentions, regexp_replace(substr(text, 1, 60), '[^A-Za-z ]+', '_', 'g') AS head FROM documents")(
    lambda documents: documents.select("doc_id", F.col("text").rlike("[0-9]{4}").alias("has_number"), F.col("text").ilike("%license%").alias("mentions"), F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z ]+", "_").alias("head"))
)
Q("STR-05", "SELECT CAST(count(*) FILTER (WHERE regexp_matches(line, 'the')) AS BIGINT) AS grep_c, CAST(count(*) FILTER (WHERE NOT regexp_matches(line, 'the')) AS BIGINT) AS grep_vc, CAST(count(*) AS BIGINT) AS wc_l, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum(length(translate(line, 'aeiou', ''))) AS BIGINT) AS tr_d FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) t")(
    lambda documents: documents.select(F.explode(F.split("text", "\n")).alias("line")).agg(F.count_if(F.col("line").rlike("the")).alias("grep_c"), F.count_if(~F.col("line").rlike("the")).alias("grep_vc"), F.count("*").alias("wc_l"), F.sum(F.length("line")).alias("chars"), F.sum(F.length(F.translate("line", "aeiou", ""))).alias("tr_d"))
)
Q.sql("STR-06", "SELECT c_custkey, right(c_name, 3) AS tail, left(c_name, 4) AS head FROM customer", tables="customer")
Q("STR-07", "SELECT page_id, url_decode('a%20b%2F' || page_id) AS key FROM pages")(lambda pages: pages.select("page_id", F.url_decode(F.concat(F.lit("a%20b%2F"), F.col("page_id").cast("string"))).alias("key")))
Q("HSH-01", "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR)) AS sk FROM orders")(lambda orders: orders.select("o_orderkey", S.surrogate_key(F.col("o_orderkey"), F.col("o_custkey")).alias("sk")))
Q("HSH-02", "SELECT doc_id, substr(sha256(text), 1, 12) AS tag FROM documents")(lambda documents: documents.select("doc_id", S.content_tag(F.col("text")).alias("tag")))
Q("HSH-03")(lambda customer: customer.select("c_custkey", S.hmac_sha256(F.col("c_name"), b"pepper").alias("pseudonym")))
Q("DAT-01", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(isodow(o_orderdate) AS INT) AS dow, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS m FROM orders")(
    lambda orders: orders.select("o_orderkey", F.trunc("o_orderdate", "month").alias("month"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.extract(F.lit("dayofweek_iso"), "o_orderdate").cast("int").alias("dow"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
)
Q("DAT-02", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS k, strftime(o_orderdate, '%Y-%m') AS ym, dayname(o_orderdate) AS name FROM orders")(lambda orders: orders.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.date_format("o_orderdate", "EEEE").alias("name")))
Q("DAT-03", "SELECT event_id, CAST(ts - INTERVAL 3 HOUR AS DATE) AS local_day FROM events")(lambda events: events.select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Etc/GMT+3")).alias("local_day")))
Q("DAT-04", "SELECT event_id, CAST(ts AS DATE) + 7 AS week_later, make_timestamp((event_id + 1700000000) * 1000000) AS at FROM events")(lambda events: events.select("event_id", F.date_add(F.to_date("ts"), 7).alias("week_later"), F.timestamp_seconds(F.col("event_id") + 1700000000).alias("at")))
Q("DAT-05", "SELECT o_orderkey, CAST(epoch(TIMESTAMP '2000-01-01 00:00:00') - epoch(o_orderdate) AS DOUBLE) / 3600 AS age_hours FROM orders")(lambda orders: orders.select("o_orderkey", ((F.lit(946684800) - F.unix_timestamp("o_orderdate")).cast("double") / 3600).alias("age_hours")))
_TIMES = "VALUES ('2024-01-05T10:00:00Z'), ('2024-01-05'), ('2024-1-5'), ('20240105'), ('2024'), ('2024-02-30'), ('2024-01-05 10:00:00+03:00'), ('x'), ('')"
Q("DAT-06", f"SELECT v, CASE v WHEN '2024-01-05T10:00:00Z' THEN TIMESTAMPTZ '2024-01-05 10:00:00+00' WHEN '2024-01-05' THEN TIMESTAMPTZ '2024-01-05 00:00:00+00' WHEN '2024-01-05 10:00:00+03:00' THEN TIMESTAMPTZ '2024-01-05 07:00:00+00' END AS at FROM ({_TIMES}) t(v)")(lambda spark: spark.sql(f"SELECT * FROM {_TIMES} t(v)").select("v", S.instant(F.col("v")).alias("at")))
Q("DAT-07", "SELECT event_id, time_bucket(INTERVAL 1 MINUTE, ts) AS w FROM events")(lambda events: events.select("event_id", F.window(F.col("ts"), "1 minute").alias("win")).select("event_id", F.col("win.start").cast("timestamp_ntz").alias("w")))
_NUMS = "VALUES ('10.005'), ('10.015'), ('1,25'), ('-1.005'), ('NaN'), ('Infinity'), ('abc'), ('2.675')"
Q("NUM-01", f"SELECT v, CASE v WHEN '10.005' THEN CAST(10.00 AS DECIMAL(12,2)) WHEN '10.015' THEN 10.02 WHEN '1,25' THEN 1.25 WHEN '-1.005' THEN -1.00 WHEN '2.675' THEN 2.68 END AS even FROM ({_NUMS}) t(v)")(lambda spark: spark.sql(f"SELECT * FROM {_NUMS} t(v)").select("v", S.money(F.col("v")).alias("even")))
Q("NUM-02", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS DECIMAL(12,2)) AS amount FROM orders")(lambda orders: orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).try_cast("decimal(12,2)").alias("amount")))
Q("NUM-03", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS f, c_custkey % 7 AS m, abs(c_acctbal) AS a, round(ln(abs(c_acctbal) + 1), 6) AS l, CAST(floor((c_acctbal + 1000) / 2000) AS BIGINT) AS bin FROM customer")(lambda customer: customer.select("c_custkey", F.floor("c_acctbal").alias("f"), (F.col("c_custkey") % 7).alias("m"), F.abs("c_acctbal").alias("a"), F.round(F.log(F.abs("c_acctbal") + 1), 6).alias("l"), F.floor((F.col("c_acctbal") + 1000) / 2000).alias("bin")))
Q("NUM-04", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem")(lambda lineitem: lineitem.select("l_orderkey", "l_linenumber", F.try_divide("l_extendedprice", "l_discount").alias("ratio")))
Q.sql("NUL-01", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS kind, nullif(value, 0) AS v FROM events", tables="events")
Q("CST-01", "SELECT event_id, TRY_CAST(raw AS BIGINT) AS n, raw IS NOT NULL AND TRY_CAST(raw AS BIGINT) IS NULL AS failed FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS raw FROM events) t")(
    lambda events: events.select("event_id", F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("x"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 2, F.col("event_id").cast("string")).alias("raw")).select("event_id", F.col("raw").try_cast("bigint").alias("n"), S.cast_failed(F.col("raw"), "bigint").alias("failed"))
)
Q("ARR-01", "SELECT o_custkey, CAST(len(list_distinct(list(o_orderstatus))) AS INT) AS statuses, list_sort(list_distinct(list(o_orderpriority)))[1] AS first_priority FROM orders GROUP BY 1")(lambda orders: orders.groupBy("o_custkey").agg(F.size(F.collect_set("o_orderstatus")).alias("statuses"), F.sort_array(F.collect_set("o_orderpriority"))[0].alias("first_priority")))
Q("ARR-02", "SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda w: length(w) > 8)) AS INT) AS long_words FROM documents")(lambda documents: documents.select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: F.length(w) > 8)).alias("long_words")))
Q("ARR-03", "SELECT o_orderkey AS pedido, l_partkey AS prod, CAST(l_quantity AS BIGINT) AS qtd FROM orders JOIN lineitem ON l_orderkey = o_orderkey")(
    lambda orders, lineitem: orders.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_partkey").alias("prod"), F.col("l_quantity").cast("long").alias("qtd")))).alias("doc")).select(F.col("o_orderkey").alias("pedido"), F.inline(F.from_json("doc", "array<struct<prod:bigint,qtd:bigint>>")))
)
Q("JSN-01", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, false AS corrupt FROM events")(lambda events: events.withColumn("r", F.from_json("props", "k bigint, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).select("event_id", F.col("r.k").alias("k"), F.col("r._corrupt").isNotNull().alias("corrupt")))
Q("JSN-02", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) = 3 AS is_three FROM events")(lambda events: events.select("event_id", F.get_json_object("props", "$.k").alias("k"), (F.try_variant_get(F.parse_json("props"), "$.k", "bigint") == 3).alias("is_three")))
Q("JSN-03", "SELECT json_extract_string(props, '$.k') AS k, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' GROUP BY 1")(lambda events: events.where("event_type = 'click'").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n")))
Q("JSN-04", """SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS js FROM orders""")(lambda orders: orders.select("o_orderkey", S.json_sorted("o_orderstatus", "o_orderkey", "o_custkey").alias("js")))
Q("MAP-01", "SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f FROM orders GROUP BY 1")(lambda orders: orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m")).select("o_custkey", F.coalesce(F.element_at("m", "F"), F.lit(0)).alias("f")))
Q("XML-01", "SELECT p_partkey, p_brand AS brand, p_size > 10 AS big FROM part")(lambda part: part.withColumn("x", F.format_string("<item qtd='%d'><brand>%s</brand></item>", "p_size", "p_brand")).select("p_partkey", F.xpath_string("x", F.lit("/item/brand")).alias("brand"), F.xpath_boolean("x", F.lit("/item[@qtd>10]")).alias("big")))
Q("HTML-01", "SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\n\\t]+', ' ', 'g'))::INT AS n FROM pages")(lambda pages: pages.select("page_id", F.length(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \n\t]+", " ")).alias("n")))

# ---- user-defined functions --------------------------------------------------------------------
_FEE = "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 100 THEN l_extendedprice * 0.05::DOUBLE ELSE l_extendedprice * 0.02::DOUBLE END AS fee FROM lineitem"


@Q("UDF-01", _FEE)
def native_fee(lineitem):
    a = F.col("l_extendedprice")
    return lineitem.select("l_orderkey", "l_linenumber", F.when(a > 100, a * 0.05).otherwise(a * 0.02).alias("fee"))


@Q("UDF-02", _FEE)
def pandas_fee(lineitem):
    @F.pandas_udf("double")
    def fee(a: pd.Series) -> pd.Series:
        return (a * 0.05).where(a > 100, a * 0.02)

    return lineitem.select("l_orderkey", "l_linenumber", fee("l_extendedprice").alias("fee"))


@Q("UDF-03", "SELECT c_custkey, round(c_acctbal * 0.1::DOUBLE, 6) AS d, round(c_acctbal * 0.2::DOUBLE, 6) AS e FROM customer")
def sql_function(spark, customer):
    customer.createOrReplaceTempView("customer")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION share_of(amount DOUBLE, rate DOUBLE DEFAULT 0.1D) RETURNS DOUBLE RETURN round(amount * rate, 6)")
    return spark.sql("SELECT c_custkey, share_of(c_acctbal) AS d, share_of(c_acctbal, 0.2D) AS e FROM customer")


@Q("UDF-04", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal' ELSE 'rich' END AS band FROM customer")
def case_function(spark, customer):
    customer.createOrReplaceTempView("customer")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION band_of(b DOUBLE) RETURNS STRING RETURN CASE WHEN b < 0 THEN 'debt' WHEN b < 5000 THEN 'normal' ELSE 'rich' END")
    return spark.sql("SELECT c_custkey, band_of(c_acctbal) AS band FROM customer")


@Q("UDF-05", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def table_function(spark, orders):
    orders.createOrReplaceTempView("orders")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION orders_of(c BIGINT) RETURNS TABLE(o_orderkey BIGINT, o_totalprice DOUBLE) RETURN SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c")
    return spark.sql("SELECT * FROM orders_of(7)")


Q("UDF-06", "SELECT o_orderkey, CAST(round(CAST(o_orderkey AS DECIMAL(18,4)) / 100, 2) AS DECIMAL(18,2)) AS units FROM orders")(lambda orders: orders.select("o_orderkey", S.cents_to_units(F.col("o_orderkey")).cast("decimal(18,2)").alias("units")))


@Q("UDF-09", "SELECT event_type, round(avg(value), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def grouped_map(events):
    """Partial sums in Arrow batches, then a native sum: a hot group is never one task's frame."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.groupby("event_type").agg(s=("value", "sum"), n=("value", "size")).reset_index()

    parts = events.select("event_type", "value").mapInPandas(partial, "event_type string, s double, n long")
    return parts.groupBy("event_type").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


# ---- the DataFrame surface ---------------------------------------------------------------------
Q("API-02", "SELECT event_type AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")(lambda events: events.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n")))
Q("API-03", "SELECT event_id, value FROM events WHERE value > 50 AND event_type = 'click'")(lambda events: events.where((F.col("value") > 50) & (F.col("event_type") == "click")).select("event_id", "value"))
Q("API-04", "SELECT o_custkey AS customer, max(o_orderkey) AS last_order FROM orders GROUP BY 1")(lambda orders: orders.withColumnRenamed("o_custkey", "customer").dropna(subset=["customer"]).groupBy("customer").agg(F.max("o_orderkey").alias("last_order")))
Q("API-05", "SELECT event_type, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")(lambda events: events.groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(18,2)").alias("total"), F.countDistinct("user_id").alias("users")))
Q("API-06", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")(lambda customer, orders: customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey"))
Q("API-07", "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2)) * 2) AS DECIMAL(18,2)) AS double_total FROM orders WHERE o_totalprice > 1000 GROUP BY 1")(lambda orders: orders.where("o_totalprice > 1000").withColumn("d", F.col("o_totalprice").cast("decimal(12,2)") * 2).groupBy("o_orderstatus").agg(F.sum("d").cast("decimal(18,2)").alias("double_total")).orderBy("o_orderstatus"))
Q("API-09", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 1.1 AS DECIMAL(16,3)) AS taxed, lower(trim(o_orderpriority)) AS p, CAST(year(o_orderdate) AS INT) AS y FROM orders")(lambda orders: orders.select("o_orderkey", (F.col("o_totalprice").cast("decimal(12,2)") * F.lit("1.1").cast("decimal(2,1)")).cast("decimal(16,3)").alias("taxed"), F.lower(F.trim("o_orderpriority")).alias("p"), F.year("o_orderdate").alias("y")))
Q("API-10", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey DESC")(lambda customer, orders: customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey").orderBy(F.desc("c_custkey")))
Q.sql("API-15", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority", tables="orders")
Q("API-16", "SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")(lambda orders: orders.where("o_orderstatus = 'F'").withColumn("day", F.to_date("o_orderdate")).groupBy("day").agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("decimal(18,2)").alias("total"), F.countDistinct("o_custkey").alias("customers")))
Q("API-19", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")(lambda events, customer: events.join(customer.where("c_acctbal > 5000"), F.col("c_custkey") == F.col("user_id"), "left_semi").select("event_id"))
Q("API-22", "SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax = 0 THEN 'tax' END], lambda x: x IS NOT NULL) AS reasons FROM lineitem")(lambda lineitem: lineitem.select("l_orderkey", "l_linenumber", S.all_reasons([(F.col("l_quantity") > 45, "quantity"), (F.col("l_discount") > 0.08, "discount"), (F.col("l_tax") == 0, "tax")]).alias("reasons")))
