"""Deduplication with the tie policy spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``. Give a total order; ties left open are broken arbitrarily."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest_by_aggregate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each key, as an aggregation: a hot key is reduced before the shuffle and never sorted whole."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the later ones with a ``reason``."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank").withColumn("reason", F.lit("duplicate"))


def merge_newer(target: DataFrame, batch: DataFrame, keys: list[str], version: str, strict: bool = True) -> DataFrame:
    """Upsert without regress: a batch row replaces its target row if its version is newer (``strict``) or not older; the batch holds a key once."""
    both = target.withColumn("__batch", F.lit(0)).unionByName(batch.withColumn("__batch", F.lit(1)))
    tie = F.col("__batch").asc() if strict else F.col("__batch").desc()
    return latest(both, keys, [F.col(version).desc_nulls_last(), tie]).drop("__batch")


def normalised_name(c: Column) -> Column:
    """Lower case, accents and punctuation off, white space single: the key for comparing names."""
    plain = F.translate(F.lower(c), "áàâãäåéèêëíìîïóòôõöúùûüçñß", "aaaaaaeeeeiiiiooooouuuucns")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def _pieces(length: Column, k: int) -> list[tuple[Column, Column]]:
    """Where the ``k + 1`` pieces of a text of some length start, from 1, and how long they are."""
    cuts = [F.floor(length * i / (k + 1)).cast("int") for i in range(k + 2)]
    return [(a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def similar_names(df: DataFrame, id: str, name: str, block: Column, most_edits: int = 2) -> DataFrame:
    """Pairs ``a < b`` within a block whose normalised names differ by at most ``most_edits``.

    Different names meet only where they can be that close: of ``most_edits + 1`` pieces of one, some piece
    stands unchanged in the other, shifted by no more than the edits. The join is on such pieces; rows of
    equal names meet through their name.
    """
    rows = df.select(F.col(id).alias("id"), normalised_name(F.col(name)).alias("name"), block.alias("block")).where("id IS NOT NULL AND name IS NOT NULL AND block IS NOT NULL")
    names = rows.select("block", "name").distinct()
    key = lambda length, i, piece: F.struct(length.cast("int").alias("length"), F.lit(i).alias("i"), piece.alias("piece"))
    own = [key(F.length("name"), i, F.substring("name", at, n)) for i, (at, n) in enumerate(_pieces(F.length("name"), most_edits))]
    other = []
    for longer in range(-most_edits, most_edits + 1):
        length = F.length("name") + longer
        for i, (at, n) in enumerate(_pieces(length, most_edits)):
            other += [F.when((length >= 0) & (at + shift >= 1), key(length, i, F.substring("name", at + shift, n))) for shift in range(-most_edits, most_edits + 1)]
    left = names.select("block", F.col("name").alias("x"), F.explode(F.array_distinct(F.array(*own))).alias("piece"))
    right = names.select("block", F.col("name").alias("y"), F.explode(F.array_distinct(F.array_compact(F.array(*other)))).alias("piece"))
    met = left.join(right, ["block", "piece"]).select("block", "x", "y").distinct()
    close = met.withColumn("edits", F.levenshtein("x", "y")).where(F.col("edits") <= most_edits)
    a, b = rows.select("block", F.col("name").alias("x"), F.col("id").alias("a")), rows.select("block", F.col("name").alias("y"), F.col("id").alias("b"))
    return close.join(a, ["block", "x"]).join(b, ["block", "y"]).where("a < b").select("a", "b", "edits")
