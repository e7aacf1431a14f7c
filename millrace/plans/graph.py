"""Property graphs as two tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.store import shared_folder


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("degree"))


def friends_of_friends(edges: DataFrame) -> DataFrame:
    """Pairs two steps apart that are not linked themselves, with the number of ways. The result holds the pairs among each node's neighbours: it grows with the squares of the degrees."""
    a = edges.select(F.col("src").alias("a"), F.col("dst").alias("via"))
    b = edges.select(F.col("src").alias("via"), F.col("dst").alias("b"))
    two = a.join(b, "via").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("ways"))
    return two.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")


def distances(edges: DataFrame, start, most_steps: int | None = None) -> DataFrame:
    """Breadth-first distances from a node, to the last one that can be reached or to a number of steps: each step joins the frontier only, and is written to the checkpoint folder to cut the plan."""
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    kind = edges.schema["src"].dataType
    seen = spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0).alias("distance"))
    frontier = seen
    for step in count(1) if most_steps is None else range(1, most_steps + 1):
        found = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = found.join(seen, "id", "left_anti").withColumn("distance", F.lit(step)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
