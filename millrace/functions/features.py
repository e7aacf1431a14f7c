"""Feature engineering, encodings and drift measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_features(events: DataFrame, key: str, time: str, value: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Counts and sums over the days before each event, the event itself excluded, and seconds since the last one. No future rows."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp(time))
    out = events
    for d in days:
        span = w.rangeBetween(-d * 86400, -1)
        out = out.withColumn(f"n_{d}d", F.count("*").over(span)).withColumn(f"sum_{d}d", F.coalesce(F.sum(value).over(span), F.lit(0).cast(out.schema[value].dataType)))
    last = F.max(F.unix_timestamp(time)).over(w.rangeBetween(Window.unboundedPreceding, -1))
    return out.withColumn("recency_s", F.unix_timestamp(time) - last)


def split_by_hash(key: Column, seed: int = 1, test_percent: int = 20) -> Column:
    """``train`` or ``test`` by a digest of the key, so that a key is on one side whenever it comes."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < test_percent, "test").otherwise("train")


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias(f"{column}_freq"))
    return df.join(counts, column)


def target_encode(df: DataFrame, column: str, target: str, weight: float = 10.0) -> DataFrame:
    """The mean target of each value, drawn towards the global mean by ``weight`` rows."""
    total = df.agg((F.sum(F.col(target).cast("double")) / F.count("*")).alias("__mean"))
    each = df.groupBy(column).agg(F.sum(F.col(target).cast("double")).alias("__s"), F.count("*").alias("__n")).join(F.broadcast(total))
    return each.select(column, ((F.col("__s") + weight * F.col("__mean")) / (F.col("__n") + weight)).alias(f"{column}_target"))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in values})


def hash_bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def min_max(c: Column, over: Window | None = None) -> Column:
    w = over or Window.partitionBy()
    return F.try_divide(c - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index: bins at the expected sample's quantiles, sum of (q - p) ln(q / p)."""
    edges = expected.agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0]
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: F.col(column) > e))
    shares = []
    for name, df in (("p", expected), ("q", actual)):
        n = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
        shares.append(n.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name)))
    both = shares[0].join(shares[1], "bin", "full").select(*[F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(eps)).alias(c) for c in "pq"])
    return both.agg(F.round(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))), 6).alias("psi"))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov: the largest distance of two distribution functions. Equal values are counted first, then summed in bins of ranges, so no task sees all values."""
    both = a.select(F.col(column).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(column).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y"))).where("v IS NOT NULL")
    binned = in_ranges(both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y")), "v")
    every = Window.partitionBy()
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    sums = binned.groupBy("bin").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    sums = sums.select("bin", *[F.coalesce(F.sum(f"s{c}").over(before), F.lit(0)).alias(f"b{c}") for c in "xy"], *[F.sum(f"s{c}").over(every).alias(f"n{c}") for c in "xy"])
    within = Window.partitionBy("bin").orderBy("v")
    cum = binned.join(F.broadcast(sums), "bin").select(*[(F.col(f"b{c}") + F.sum(c).over(within)).alias(f"c{c}") for c in "xy"], "nx", "ny")
    return cum.agg(F.round(F.max(F.abs(F.col("cx") / F.col("nx") - F.col("cy") / F.col("ny"))), 6).alias("ks"))


def in_ranges(df: DataFrame, column: str, bins: int = 200) -> DataFrame:
    """``df`` with ``bin``, a number that grows with a column: ranges between approximate quantiles, so each holds about as many rows."""
    share = [i / bins for i in range(1, bins)]
    edges = sorted(set(df.agg(F.percentile_approx(column, share, 10_000)).first()[0] or []))
    return df.withColumn("bin", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(column))) if edges else F.lit(0))


def row_index(df: DataFrame, column: str, name: str = "_rn", bins: int = 200) -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of a numeric column without ties: ranges are counted, then rows within one."""
    binned = in_ranges(df, column, bins)
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    counts = binned.groupBy("bin").agg(F.count("*").alias("n")).select("bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy(column))
    return binned.join(F.broadcast(counts), "bin").select(*df.columns, place.alias(name))


def chi_square(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Chi-square of two samples over the categories of a column."""
    n = lambda df, name: df.groupBy(column).agg(F.count("*").alias(name))
    both = n(a, "a").join(n(b, "b"), column, "full").fillna(0, ["a", "b"])
    every = Window.partitionBy()
    t = both.select("a", "b", F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb"))
    row = F.col("a") + F.col("b")
    ea, eb = row * F.col("na") / (F.col("na") + F.col("nb")), row * F.col("nb") / (F.col("na") + F.col("nb"))
    return t.agg(F.round(F.sum((F.col("a") - ea) ** 2 / ea + (F.col("b") - eb) ** 2 / eb), 6).alias("chi2"))


def tf_idf(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id, word, tf, df, tf_idf`` with idf = ln(n / df)."""
    words = docs.select(id, F.explode(F.split(F.lower(text), r"[ \n\t\r]+")).alias("word")).where("word <> ''")
    tf = words.groupBy(id, "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return tf.join(df, "word").join(F.broadcast(n)).select(id, "word", "tf", "df", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6).alias("tf_idf"))
