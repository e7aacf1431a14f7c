"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate, however often each site repeats it. Every line's
hash gets a HyperLogLog sketch of the sites it was seen on; sketches are made before the shuffle and
merged after it, so a line that a third of all documents share sends one sketch from each task. Lines
whose estimate is clearly under or over the threshold are decided by it; those within ``BAND`` of
the threshold get an exact count of their distinct sites, over pairs of line and site that are made
distinct before they meet. Lines on at least ``SITES`` sites are taken out of every document.

Lines are compared by a 64-bit hash of their text without white space at its ends. Only hashes that
occur at least ``SITES`` times are sketched: fewer occurrences cannot reach the threshold. Up to
``MOST_LISTED`` boilerplate hashes go to the texts as a hash set within the expression, and texts are
not shuffled; beyond it texts meet the hashes of their own lines by a join.

Defined results: a null text is empty and stays null; blank lines and those under ``WORDS`` words are
never boilerplate; a null site is a site of its own; rows that repeat an id are cleaned alike, each by
itself; a text that loses all lines becomes empty; a very long text is split whole, in its own row; other
columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialised

SITES = 5
WORDS = 3
#: Estimates within this factor of the threshold are settled exactly; the sketch's own error is 1.6 % at 2**12 registers.
BAND = 0.25
REGISTERS = 12
#: Boilerplate hashes that an expression may list: 160 kB of them.
MOST_LISTED = 20_000
#: Hashes that are broadcast to pick their lines: 8 MB of them.
MOST_SENT = 1_000_000
_EDGE = " \t\n\r\x0b\x0c"
_LONG = rf"^[{_EDGE}]*([^{_EDGE}]+[{_EDGE}]+){{{WORDS - 1}}}[^{_EDGE}]"


def line_key(line: Column) -> Column:
    """The hash of a line, null for one that is too short to be boilerplate."""
    return F.when(F.regexp_like(line, F.lit(_LONG)), F.xxhash64(F.btrim(line, F.lit(_EDGE))))


def lines_of(docs: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``id, version, site, key`` of each row's different lines, written. ``version`` tells texts under one id apart."""
    keys = F.array_distinct(F.transform(F.split(F.col(text), "\n"), line_key))
    named = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n"))
    lines = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("version"), named.alias("site"), F.explode(keys).alias("key"))
    return materialised(lines.where("key is not null"), "lines")


def _of(lines: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """``key, site`` of the lines with one of some keys: where they stand if the keys are few enough to send, else met by a shuffle of distinct pairs."""
    if keys.count() <= most:
        return lines.join(F.broadcast(keys), "key", "left_semi").select("key", "site")
    return lines.groupBy("key", "site").agg(F.count("*").alias("n")).join(keys, "key", "left_semi").select("key", "site")


def boilerplate(lines: DataFrame, sites: int = SITES, band: float = BAND, most_sent: int = MOST_SENT) -> DataFrame:
    """``key`` of every line that stands on at least ``sites`` sites."""
    often = materialised(lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("key"), "often")
    sketched = _of(lines, often, most_sent).groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", REGISTERS)).alias("n"))
    spread = materialised(sketched.where(F.col("n") >= sites * (1 - band)), "spread")
    near = spread.where(F.col("n") <= sites * (1 + band)).select("key")
    pairs = _of(lines, near, most_sent).groupBy("key", "site").agg(F.count("*").alias("n"))
    exact = pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return spread.where(F.col("n") > sites * (1 + band)).select("key").unionByName(exact.select("key"))


def clean(docs: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, most_listed: int = MOST_LISTED) -> DataFrame:
    """``id``, the cleaned ``text``, ``n_lines`` and ``n_removed`` for each row."""
    lines = lines_of(docs, id, text, site)
    gone = materialised(boilerplate(lines, sites), "boilerplate")
    listed = [r[0] for r in gone.limit(most_listed + 1).collect()]
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    if len(listed) <= most_listed:
        split = F.split("text", "\n")
        rows = rows.select("id", "text", split.alias("lines"), F.filter(split, lambda x: ~F.coalesce(line_key(x).isin(listed), F.lit(False))).alias("left"))
    else:
        rows = _met(rows, lines, gone)
    removed = F.size("lines") - F.size("left")
    return rows.select(F.col("id").alias(id), F.when(removed > 0, F.array_join("left", "\n")).otherwise(F.col("text")).alias("text"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))


def _met(rows: DataFrame, lines: DataFrame, gone: DataFrame) -> DataFrame:
    """``id, text, lines, left``: texts meet their own boilerplate hashes by id and version."""
    found = lines.join(gone, "key", "left_semi").groupBy(F.col("id").alias("__id"), F.col("version").alias("__version")).agg(F.collect_set("key").alias("__keys"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    rows = rows.join(found, rows.id.eqNullSafe(found["__id"]) & (rows.version == found["__version"]), "left")
    split = F.split("text", "\n")
    left = F.filter(split, lambda x: ~F.coalesce(F.array_contains("__keys", line_key(x)), F.lit(False)))
    return rows.select("id", "text", split.alias("lines"), F.when(F.col("__keys").isNull(), split).otherwise(left).alias("left"))


def report(docs: DataFrame) -> DataFrame:
    return clean(docs)


ORACLE = r"""WITH l AS (SELECT coalesce('s' || source, 'n') AS site, unnest(list_distinct(list_transform(list_filter(string_split(text, chr(10)),
    lambda x: regexp_matches(x, '^[ \t\n\r\x0b\x0c]*([^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]+){2}[^ \t\n\r\x0b\x0c]')), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))))) AS line FROM documents),
b AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT site) >= 5),
g AS (SELECT coalesce(list(line), []) AS gone FROM b),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))) AS kept FROM documents, g)
SELECT doc_id, CASE WHEN len(kept) = len(lines) THEN text ELSE array_to_string(kept, chr(10)) END AS text, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_removed FROM d"""
