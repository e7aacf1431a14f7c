"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / w``: ``u`` is uniform, drawn from a keyed digest of its id and
text, so reruns agree; ``w`` is its quality weight. Documents taken in ascending key order are a
weighted sample without replacement. A source whose target is ``k`` times its size and a rest takes
every document ``k`` times, whole epochs first, and then documents by key until the rest is spent.

Scale: the order within a source is never one task's sort. Keys fall into bins by their logarithm,
which hold at most about ``BIN_ROWS`` documents whatever the weights are; sizes are summed by source
and bin (with partial sums before the shuffle), the sums run over bins, and only rows of the same
source and bin are sorted together. Targets come from one row per source.

Defined results: a null text has size 0; a null source is a source of its own, after all others; ids
may be null or repeat: rows equal in id and text share a key and are taken in one go by their
place in the sort; an empty table gives an empty one; if all sizes are 0, all targets are 0. A document
of size 0 takes no words and is drawn as often as any other at its place in the order, once in a source
without any word. Of a very long text only counts are held. Other columns, whatever their names, pass
through :func:`sample` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, materialised, numbered, place, row_key

CAP = 3
BIN_ROWS = 5_000
#: Characters that prose has few of; their share lowers a document's weight.
NOISE = "0123456789#*$%&|<>{}[]\\^~_=+@/"


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of a text's characters that aren't digits or symbols, 1 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, 0.1 + 0.9 * F.length(F.translate(text, NOISE, "")) / n).otherwise(F.lit(1.0))


def uniform(id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("")), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def bin_of(key: Column, rows: int, bin_rows: int) -> Column:
    """A bin that grows with the key. Of exponential keys, whatever their weights, a step of 1 / n in the logarithm holds at most 1 / (e n)."""
    steps = max(1, math.ceil(rows / (math.e * bin_rows)))
    return F.coalesce(F.floor(F.log(key) * steps), F.lit(-(1 << 62)))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, size`` to ``source, source_size, target``: weights 1, 2, 3, repeating, capped at ``CAP`` sizes, the excess reshared by weight.

    In the order of cap over weight the capped sources come first, so the level at which the
    resharing ends is found with running sums instead of a loop.
    """
    every = Window.partitionBy()
    ranked = sizes.select("source", F.col("size").alias("s"), F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("place"))
    ranked = ranked.withColumn("w", ((F.col("place") - 1) % 3 + 1).cast("double")).withColumn("total", F.sum("s").over(every).cast("double"))
    order = Window.orderBy((F.col("s") / F.col("w")).asc(), "place")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("capped", CAP * F.coalesce(F.sum("s").over(upto), F.lit(0)).cast("double")).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.try_divide(F.col("total") - F.col("capped"), "w_left"))
    # the first source in the order whose cap is above the level fixes the level for all from there on
    fixed = F.min(F.when(F.col("level") * F.col("w") <= CAP * F.col("s"), F.struct((F.col("s") / F.col("w")).alias("q"), "place", "level"))).over(every)
    ranked = ranked.withColumn("fixed", fixed)
    return ranked.select("source", F.col("s").alias("source_size"), F.least(CAP * F.col("s").cast("double"), F.coalesce(F.col("fixed.level") * F.col("w"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, seed: int = 20, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``id, size, source_size, target, taken`` and the key, for each row. ``quality``: a positive weight, by default :func:`quality_weight`."""
    return _mix(docs, id, text, source, quality, seed, bin_rows, F.lit(None).cast("binary")).drop("row", "times")


def _mix(docs: DataFrame, id: str, text: str, source: str, quality: Column | None, seed: int, bin_rows: int, row: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    weight = quality_weight(F.col(text)) if quality is None else quality
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), size.alias("size"), (-F.log(uniform(F.col(id), F.coalesce(F.col(text), F.lit("")), seed)) / F.coalesce(weight, F.lit(1.0))).alias("key"), row.alias("row"))
    rows = materialised(rows, "mix")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    most = by_source.agg(F.max("n")).first()[0] or 0
    rows = rows.withColumn("bin", bin_of(F.col("key"), most, bin_rows))
    targets = source_targets(by_source.select("source", "size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("s")).withColumn("start", F.coalesce(F.sum("s").over(before), F.lit(0)))
    plan = sums.join(targets, sums.source.eqNullSafe(targets.source)).select(sums.source, sums.bin, "s", "start", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # a bin that ends before the rest is spent goes whole, one that starts after it stays out
    return _take(rows, plan).select(F.col("id").alias(id), "size", "source_size", "target", "taken", "key", "row", "times")


def _take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bin") == F.col("p.bin"))).select("r.id", "r.source", "r.bin", "r.size", "r.key", "r.row", "start", "s", "source_size", "target", "epochs", "rest")
    order = Window.partitionBy("source", "bin").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    done = joined.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # the document at the edge is taken if that ends nearer to the target
    once = (F.col("before") + F.col("size") / 2 <= F.col("rest")) & (F.col("before") < F.col("rest"))
    times = F.when(F.col("source_size") == 0, 1).otherwise(F.col("epochs") + once.cast("long")).cast("long")
    return done.withColumn("times", times).withColumn("taken", F.col("size") * F.col("times"))


def sample(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    own = numbered(docs)
    i, t, s = (place(docs, c) for c in (id, text, source))
    row = F.unhex(F.sha2(F.concat(F.hex(row_key(F.col(i), F.col(t))), F.coalesce(F.concat(F.lit("="), F.col(s).cast("string")), F.lit(""))), 256))
    drawn = _mix(own, i, t, s, None, 20, BIN_ROWS, row).select("row", F.col("times").cast("int").alias("n"))
    # rows equal in id, text and source are drawn as often, or some of them once more where the rest is spent
    taken = drawn.groupBy("row").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("rows"), F.sum("n").alias("sum")).where("most > 0")
    taken = materialised(taken, "taken")
    keyed = own.withColumn("row", row)
    even, edge = taken.where("n = most"), taken.where("n < most")
    joined = keyed.join(even, "row").select(*own.columns, "n")
    if not edge.isEmpty():  # one group a source at most
        at = F.row_number().over(Window.partitionBy("row").orderBy(F.lit(1)))
        some = keyed.join(F.broadcast(edge), "row").withColumn("at", at)
        joined = joined.unionByName(some.select(*own.columns, F.when(F.col("at") <= F.col("sum") - F.col("n") * F.col("rows"), F.col("most")).otherwise(F.col("n")).alias("n")).where("n > 0"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*own.columns).toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE WHEN length(coalesce(text, '')) > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * length(translate(text, '0123456789#*$%&|<>{}[]\^~_=+@/', '')) / length(text) ELSE 1.0::DOUBLE END AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS w, (sum(s) OVER ())::DOUBLE AS total FROM s),
c AS (SELECT *, 3 * coalesce(sum(s) OVER o, 0)::DOUBLE AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
  FROM w WINDOW o AS (ORDER BY s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped) / w_left AS level FROM c),
f AS (SELECT level AS fixed FROM l WHERE level * w <= 3 * s ORDER BY s / w, place LIMIT 1),
t AS (SELECT source, s AS source_size, least(3 * s::DOUBLE, coalesce((SELECT fixed FROM f) * w, 0)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
b AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN before + size / 2 <= rest AND before < rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b"""
