"""The flagship query."""

from pyspark.sql import functions as F

from millrace.queries.registry import Registry

Q = Registry()


@Q(
    "AGG-12",
    """SELECT CAST(o_orderdate AS DATE) AS order_date, n_name, CAST(count(*) AS BIGINT) AS orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS revenue,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS avg_ticket
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus <> 'P' GROUP BY ALL""",
)
def daily_revenue(orders, customer, nation):
    """Non-cancelled orders (status P stands for cancelled), revenue and average ticket by day and nation."""
    money = F.sum(F.col("o_totalprice").cast("decimal(12,2)"))
    joined = (
        orders.where("o_orderstatus <> 'P'")
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy(F.to_date("o_orderdate").alias("order_date"), "n_name").agg(
        F.count("*").alias("orders"), money.cast("decimal(18,2)").alias("revenue"), (money.cast("double") / F.count("*")).alias("avg_ticket")
    )
