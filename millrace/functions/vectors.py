"""Vectors: distances, exact top-k, and an inverted-file index."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast at a time.
BLOCK_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, id, similarity, rank``: the exact k nearest by cosine. The stated queries are compared with all rows, in blocks of ``BLOCK_BYTES`` that are broadcast one by one; each query keeps k rows per task before the merge."""
    q = queries.select(F.col(id).alias("query"), F.col(vector).alias("__q"))
    n, width = q.agg(F.count("*"), F.max(F.size("__q"))).first()
    blocks = max(1, math.ceil(n * (16 + 8 * (width or 0)) / BLOCK_BYTES))
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("__v"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    out = []
    for block in range(blocks):
        some = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block) if blocks > 1 else q
        pairs = rows.join(F.broadcast(some), F.lit(True)).where("query <> id")
        scored = pairs.select("query", "id", F.round(cosine(F.col("__q"), F.col("__v")), 6).alias("similarity"))
        out.append(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    return reduce(DataFrame.unionByName, out)


def assign_cells(vectors: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> Column:
    """The nearest centroid of an inverted file, by distance."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    distances = F.transform(table, lambda c, i: F.struct(l2(F.col(vector), c).alias("d"), i.alias("i")))
    return F.array_min(distances)["i"]


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 8, probes: int = 3, id: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """Approximate top-k: k-means cells are fitted on a bounded sample, every row is indexed, queries look into their nearest cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.orderBy(F.xxhash64(id)).limit(20_000)
    model = KMeans(k=cells, seed=seed, featuresCol="f").fit(sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("f")))
    centroids = [list(c) for c in model.clusterCenters()]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    indexed = vectors.select(F.col(id).alias("id"), F.col(vector).alias("__v")).withColumn("cell", assign_cells(vectors, centroids, "__v"))
    order = F.slice(F.array_sort(F.transform(table, lambda c, i: F.struct(l2(F.col("__q"), c).alias("d"), i.alias("i")))), 1, probes)
    probe = queries.select(F.col(id).alias("query"), F.col(vector).alias("__q")).withColumn("cell", F.explode(F.transform(order, lambda s: s["i"])))
    scored = indexed.join(probe, "cell").where("query <> id").select("query", "id", F.round(cosine(F.col("__q"), F.col("__v")), 6).alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
