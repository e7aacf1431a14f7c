"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is split into two halves of 32 bits. Two fingerprints with at most three
differing bits have at most one in some half, so the search is a covering-code search on each half
with a threshold of one. The anchors of a half are the words of the Hamming (31, 26) code with one
bit appended, 2**27 of them; their covering radius is one. A fingerprint lives at its nearest
anchor, and is replicated to every anchor within radius plus threshold, two: 17 at most. Whatever
differs in one bit of the half therefore meets at the anchor where one of the pair lives, and is
compared there on all 64 bits.

Scale: fingerprints are made distinct before they are replicated, so copies cost one row. What an
anchor holds is streamed through a task, compared in blocks with vectors, and only a spanning forest
of its links leaves, never its pairs. An anchor with more than ``OVERFLOW`` fingerprints is dealt out
anew by the bytes of the other half (of four bytes one is equal, as at most three bits differ), what is
still as large by three of six pieces of it, and then by five of eight, so no anchor has a cap and none is
lost. Components come from alternating star contraction over tables in
the shared folder; neither links nor fingerprints reach the driver.

Defined results: null and empty texts, and those without a word, have fingerprint zero and are linked
like any other; rows that repeat an id each get the component of their own fingerprint; a null id is
never a component's id unless all its ids are null; an empty table gives an empty one. Of a very long
text every shingle counts; its words and 64 Ki hashes at a time are in memory. Other columns, whatever
their names, pass through :func:`keep` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialised, numbered, place, row_key

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Rows of one anchor that a task compares by itself; beyond it they are dealt out by a second key.
OVERFLOW = 1 << 19
#: How such an anchor is dealt out, level by level: of so many pieces of the other half, by each choice of so many.
FINER = ((4, 1), (6, 3), (8, 5))
_BLOCK = 1024


def fingerprint(raw: bytes) -> int:
    """SimHash of the 3-word shingles of a text whose A-Z are lower-cased first."""
    words = raw.lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size) - 1
        starts = ends - size + 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed long, for each row."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(x or b"") for x in raw.to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp long")


# Position 1..31 of each of the 31 lower bits: the syndrome of a word is the exclusive or of the positions of its ones.
_PAIRS = np.array([[(i, i ^ s) for i in range(1, 32) if i < i ^ s and i ^ s] if s else [(0, 0)] * 15 for s in range(32)], np.uint64)


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.uint64)
    for place in range(1, 32):
        out ^= ((half >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


def _bit(place: np.ndarray) -> np.ndarray:
    """The bit at each position; position 0 is no bit."""
    return np.where(place > 0, np.uint64(1) << (np.maximum(place, np.uint64(1)) - np.uint64(1)), np.uint64(0))


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 32-bit half its row, an anchor within two bits, and whether it is the nearest, flattened."""
    rows = np.arange(len(half))
    s = _syndrome(half)
    home = half ^ _bit(s)
    flipped = home ^ np.uint64(1 << 31)
    off = np.flatnonzero(s)  # those at distance one from their anchor see 15 more at distance two
    pairs = _PAIRS[s[off].astype(np.int64)]
    more = (half[off, None] ^ _bit(pairs[:, :, 0]) ^ _bit(pairs[:, :, 1])).ravel()
    where = np.concatenate([rows, rows, np.repeat(off, 15)])
    return where, np.concatenate([home, flipped, more]), np.concatenate([np.ones(len(half), bool), np.zeros(len(half) + len(more), bool)])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                half = (fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
                where, anchor, home = anchors(half)
                key = (anchor << np.uint64(1)) | np.uint64(side)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(~home), pa.array(fp[where].view(np.int64))], names=["key", "away", "fp"])


class _Forest:
    """Union-find over the rows of one anchor."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while True:  # every label points at a root again
                up = label[label]
                if (up == label).all():
                    break
                label = up
            self.label = label


def _links(fp: np.ndarray, homes: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the rows of an anchor; the first ``homes`` live there."""
    n, forest = len(fp), _Forest(len(fp))
    if n > 16 * _BLOCK and other is not None:  # at most three bits differ, so one byte of the other half is equal
        for byte in range(4):
            value = (other >> np.uint64(8 * byte)) & np.uint64(255)
            order = np.lexsort((np.arange(n), value))
            edges = np.flatnonzero(np.diff(value[order])) + 1
            for rows in np.split(order, edges):
                _compare(fp, rows, int(np.searchsorted(rows, homes)), forest)
    else:
        _compare(fp, np.arange(n), homes, forest)
    linked = np.flatnonzero(forest.label != np.arange(n))
    return fp[forest.label[linked]], fp[linked]


def _compare(fp: np.ndarray, rows: np.ndarray, homes: int, forest: _Forest) -> None:
    own = fp[rows]
    for i in range(0, homes, _BLOCK):
        for j in range(i, len(rows), 8 * _BLOCK):
            a, b = np.nonzero(np.bitwise_count(own[i : min(i + _BLOCK, homes), None] ^ own[None, j : j + 8 * _BLOCK]) <= MOST_BITS)
            a, b = a + i, b + j
            forest.add(rows[a[a < b]], rows[b[a < b]])


def _meet(overflow: int | None):
    """Compare the runs of equal keys in rows sorted by key, away, fp. ``overflow`` is None where keys have no cap."""

    def small(key: np.ndarray, away: np.ndarray, fp: np.ndarray, size: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        most = int(size.max(initial=1))
        for step in range(1, most):
            i = np.flatnonzero((run[:-step] == run[step:]) & ~away[:-step]) if step < len(run) else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= MOST_BITS]
            left.append(fp[i])
            right.append(fp[i + step])
        return np.concatenate(left or [fp[:0]]), np.concatenate(right or [fp[:0]])

    def out(a: np.ndarray, b: np.ndarray, key: int | None = None, away: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, key or 0), mask=np.full(n, key is None)), pa.array(away if away is not None else np.zeros(n, bool))], names=["a", "b", "key", "away"])

    def settle(key: np.ndarray, away: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.append(starts, len(key)))
        run = np.repeat(np.arange(len(starts)), size)
        for k in np.flatnonzero(size > 48):
            s = slice(starts[k], starts[k] + size[k])
            other = (fp[s] >> np.uint64(32 * (1 - int(key[starts[k]] & 1)))) & np.uint64(0xFFFFFFFF)
            yield out(*_links(fp[s], int((~away[s]).sum()), other))
        few = (size <= 48)[run] if len(run) else np.empty(0, bool)
        yield out(*small(key[few], away[few], fp[few], size[size <= 48], run[few]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n, over = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, away, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)
            if over is not None:  # the rest of a run that was too long to hold
                end = int(np.searchsorted(key, over, "right"))
                yield out(fp[:end], fp[:end], over, away[:end])
                key, away, fp = key[end:], away[end:], fp[end:]
                if not len(key):
                    continue
                over = None
            held.append((key, away, fp))
            n += len(key)
            if n >= (1 << 17) or overflow and n >= overflow:
                key, away, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
                yield from settle(key[:cut], away[:cut], fp[:cut])
                held, n = [(key[cut:], away[cut:], fp[cut:])], len(key) - cut
                if overflow and n >= overflow:
                    over = int(key[-1])
                    yield out(fp[cut:], fp[cut:], over, away[cut:])
                    held, n = [], 0
        if held:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _dealt(rows: DataFrame, n: int, same: int) -> DataFrame:
    """``key, away, fp`` of rows of one anchor each (``key``), dealt out by every choice of ``same`` of ``n`` pieces of the other half."""
    cuts = [32 * i // n for i in range(n + 1)]
    other = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF))
    choices = list(combinations(range(n), same))

    def value(choice: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in choice:
            bits = cuts[i + 1] - cuts[i]
            out = F.shiftleft(out, bits) + F.shiftright(other, cuts[i]).bitwiseAND(F.lit((1 << bits) - 1))
        return out

    dealt = F.explode(F.array(*[value(c) * len(choices) + i for i, c in enumerate(choices)]))
    # the key keeps its side in the lowest bit and its anchor above it
    return rows.select("key", "away", "fp", dealt.alias("part")).select((F.shiftleft("part", 33) + F.col("key")).alias("key"), "away", "fp")


def links(distinct: DataFrame, overflow: int = OVERFLOW) -> DataFrame:
    """Links ``a``, ``b`` that connect whatever the links of at most three bits connect. ``distinct``: column ``fp``, each value once."""

    def met(rows: DataFrame, cap: int | None) -> DataFrame:
        dealt = rows.repartition("key").sortWithinPartitions("key", "away", "fp")
        return materialised(dealt.mapInArrow(_meet(cap), "a long, b long, key long, away boolean"), "links")

    out = met(distinct.select("fp").mapInArrow(_replicate, "key long, away boolean, fp long"), overflow)
    pairs = out.where("key is null").select("a", "b")
    for level, (n, same) in enumerate(FINER):
        again = out.where("key is not null")
        if again.isEmpty():
            break
        rows = again.select(F.col("key").bitwiseAND(F.lit((1 << 33) - 1)).alias("key"), "away", F.col("a").alias("fp")).distinct()
        out = met(_dealt(rows, n, same), overflow if level + 1 < len(FINER) else None)
        pairs = pairs.unionByName(out.where("key is null").select("a", "b"))
    return pairs.distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node`` and ``root``, the least node it is connected to, for each node of ``edges`` (``a``, ``b``): large and small stars by turns."""
    edges = materialised(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "stars")
    before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a < b").distinct()
        now = materialised(small, "stars")
        discard(edges)
        edges = now
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``fp`` and ``component``, the least id that links lead to, for each row."""
    each = materialised(fingerprints(docs, id, text), "fingerprints")
    distinct = materialised(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(by_root, "root").select("fp", "component")
    return each.join(classes, "fp").select(F.col("id").alias(id), "fp", "component")


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: the one with the least id, null ids last, ties by a digest of the text.

    Rows are told apart by id and text, so a repeated id loses only the rows whose own text is a copy, and
    rows with null ids are groups' members like others. Of rows equal in both one stays.
    """
    own = numbered(docs)
    i, t = place(docs, id), place(docs, text)
    keyed = own.withColumn("row", row_key(F.col(i), F.col(t)))
    each = materialised(fingerprints(keyed.select(F.struct(F.col(i).isNull().alias("n"), F.col(i).alias("id"), "row").alias("who"), F.col(t).alias("text")), "who", "text"), "fingerprints")
    distinct = materialised(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("least", F.coalesce("root", "fp").alias("root"))
    stays = materialised(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.row"), "stays")
    often = each.groupBy("id.row").agg(F.count("*").alias("n")).where("n > 1").select("row")
    often = materialised(stays.join(often, "row", "left_semi"), "often")
    out = keyed.join(stays.join(often, "row", "left_anti"), "row", "left_semi").select(*own.columns)
    if not often.isEmpty():  # rows equal in id and text: one of each, by partial aggregates before the shuffle
        out = out.unionByName(keyed.join(often, "row", "left_semi").dropDuplicates(["row"]).select(*own.columns))
    return out.toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    done = near_duplicates(docs)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
