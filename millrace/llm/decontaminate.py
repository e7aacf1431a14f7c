"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of ``e`` edits is split into ``e + 1`` pieces: whatever holds the item
with at most ``e`` edits holds some piece unchanged. An Aho-Corasick automaton over the pieces finds
these hits in one pass over each whole text, and Myers' bit-parallel algorithm verifies each hit's
neighbourhood. Texts and items are normalised alike: lower case, every run of punctuation, white
space and symbols one space; so a hit does not hang on layout.

Scale: texts are never shuffled, and are read and normalised once, whatever the benchmark's size. Items
are normalised by tasks and written to the shared folder, in blocks of about ``BLOCK_BYTES``; a task
holds ``CHUNK_BYTES`` of normalised texts and lets block after block pass over them. Each worker keeps
the automata of its last ``MOST_KEPT`` blocks, so a benchmark of that many blocks is loaded once for
each worker. Repeated neighbourhoods, as in passages that many documents share, are verified once per
block and worker. Neither items nor hits reach the driver.

Defined results: null and empty texts match nothing; an item that is null or has no letter or digit
matches nothing; items repeated under one or more ids match under each; a null id is an id like
others; a very long text is searched whole, in a chunk of its own if need be; other columns, whatever
their names, pass through :func:`keep` untouched; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import materialised, numbered, place, row_key, scratch_path

#: Edits allowed for each character of a normalised item.
ERROR_RATE = 0.05
#: Normalised item bytes in a block; its automaton takes about 50 times as much memory.
BLOCK_BYTES = 1 << 20
#: Normalised text bytes that wait for the blocks to pass.
CHUNK_BYTES = 32 << 20
MOST_KEPT = 4
_MEMO = 50_000

_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WIDE = re.compile(r"\W+")


def normalise(text: str) -> str:
    """Lower case; runs of anything but letters and digits become one space; none at the ends."""
    text = text.lower()
    if not text.isascii():
        text = _WIDE.sub(" ", unicodedata.normalize("NFC", text))
    return b" ".join(text.encode().translate(_BREAKS).split()).decode()


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' algorithm for one item: its least edit distance to any part of a text, in one word of any width."""

    def __init__(self, item: str):
        self.m = len(item)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        mask, top = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score = mask, 0, self.m
        best, peq = score, self.peq
        for c in text:
            eq = peq.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(xh | plus) & mask
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up = up << 1 & mask  # the match may start anywhere
            plus = (down << 1 | ~(xv | up)) & mask
            minus = up & xv
        return best


class Block:
    """The automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items, where = [], {}
        for id, item in items:
            e = budget(item, rate)
            k = len(self.items)
            self.items.append((id, item, e, Pattern(item)))
            for offset, piece in pieces(item, e):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.memo: dict[tuple[int, str], int] = {}

    def find(self, text: str) -> dict[int, int]:
        """Items, by their place in the block, and the least distance found, for items within their budget."""
        text = f" {text} "
        found: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        for end, (size, uses) in self.automaton.iter(text):
            start = end - size + 1
            for k, offset in uses:
                if found.get(k) == 0 or (k, start - offset) in seen:
                    continue
                seen.add((k, start - offset))
                _, item, e, pattern = self.items[k]
                at = start - offset
                if e == 0 and not (text[at - 1 : at] == " " and text[at + len(item) : at + len(item) + 1] == " "):
                    continue  # an item too short for edits stands as whole words
                near = text[max(0, at - e) : at + len(item) + e]
                if item in near:
                    found[k] = 0
                    continue
                if (d := self.memo.get((k, near))) is None:
                    if len(self.memo) >= _MEMO:
                        self.memo.clear()
                    d = self.memo[k, near] = pattern.distance(near)
                if d <= e and d < found.get(k, e + 1):
                    found[k] = d
        return found


def blocks(benchmark: DataFrame, id: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[str, int]:
    """Where the items lie, ``item, text`` in a folder for each block, and how many blocks there are."""
    kind = benchmark.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normalise(raw or "") for raw in batch.column(1).to_pylist()], pa.string())], names=["item", "text"])

    items = materialised(benchmark.select(F.col(id).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, text string").where("text <> ''"), "items")
    n = math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes)
    path = scratch_path(benchmark.sparkSession, "blocks")
    if n:
        block = F.pmod(F.xxhash64("text"), F.lit(n))  # equal items are in one block
        items.withColumn("block", block).repartition(min(n, 1000), "block").write.partitionBy("block").parquet(path)
    return path, n


_KEPT: OrderedDict[tuple, Block] = OrderedDict()


def _block(path: str, n: int, rate: float) -> Block:
    """Block ``n`` of a folder; one for each worker process, so that it lasts over tasks."""
    key = path, n, rate
    if key not in _KEPT:
        while len(_KEPT) >= MOST_KEPT:
            _KEPT.popitem(last=False)
        store, root = fs.FileSystem.from_uri(path)
        found = store.get_file_info(fs.FileSelector(f"{root}/block={n}", allow_not_found=True))
        parts = [pq.read_table(f.path, filesystem=store, partitioning=None) for f in found if f.path.endswith(".parquet")]
        _KEPT[key] = Block([row for t in parts for row in zip(t.column("item").to_pylist(), t.column("text").to_pylist(), strict=True)], rate)
    _KEPT.move_to_end(key)
    return _KEPT[key]


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``id``, ``item_id``, ``distance``: one row for each document and item within budget."""
    kind, item_kind = docs.schema[id].dataType, benchmark.schema[item_id].dataType
    doc_type, item_type = to_arrow_type(kind), to_arrow_type(item_kind)
    path, n_blocks = blocks(benchmark, item_id, item_text, block_bytes)

    def search(held: list[tuple[object, str]]) -> Iterator[pa.RecordBatch]:
        for n in range(n_blocks):
            block = _block(path, n, rate)
            found = [(id, block.items[k][0], d) for id, text in held for k, d in block.find(text).items()] if block.items else []
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (doc_type, item_type, pa.int32()), strict=True)], names=["doc", "item", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows if n_blocks else 0, 256):
                for id, raw in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if raw:
                        held.append((id, normalise(raw)))
                        size += len(held[-1][1])
                if size >= (chunk_bytes if n_blocks > 1 else 1):
                    yield from search(held)
                    held, size = [], 0
        yield from search(held)

    chosen = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    out = chosen.mapInArrow(run, f"doc {kind.simpleString()}, item {item_kind.simpleString()}, distance int")
    return out.select(F.col("doc").alias(id), F.col("item").alias(item_id), "distance")


def keep(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item is found. Each row is judged by its own text, also where ids are null or repeat."""
    own = numbered(docs)
    i, t = place(docs, id), place(docs, text)
    keyed = own.withColumn("row", row_key(F.col(i), F.col(t)))
    found = materialised(matches(keyed, benchmark, "row", t).select("row").distinct(), "leaks")
    return keyed.join(found, "row", "left_anti").select(*own.columns).toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each contaminated document: its items in order, their number, and the least distance."""
    each = matches(docs, benchmark)
    return each.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.countDistinct("item_id").alias("n_items"), F.min("distance").alias("least_distance"))
