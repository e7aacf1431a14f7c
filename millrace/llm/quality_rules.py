"""Quality rules by compression bands.

Every whole text is compressed with zstandard, once as a whole and once in chunks that cover it. A
text that shrinks too much is repetitive, one that hardly shrinks is noise; what is too much depends
on the length, because a compressor finds more repeats in more text. Base statistics (words, symbols,
repeated lines, repeated five-word windows) come from the same pass, so the text is read once and
nothing is shuffled.

Defined results: a null text counts as empty; an empty text has zero words and fails the base rule;
null or repeated ids and any other columns, whatever their names, pass through untouched; a very long
text is measured whole, with its words as numbers; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import numbered, place

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_STARTS = bytes(range(0x80, 0xC0))
WINDOW = 5


@dataclass(frozen=True)
class Band:
    """Limits of raw bytes / compressed bytes for texts of ``n_bytes`` bytes."""

    n_bytes: int
    lowest: float
    highest: float


#: The least and the greatest ratio of clean prose at each length, as measured on the sf0.1 documents with quality
#: label 1 that pass the base rule (those within 0.4 octaves, brought to the length by the trend); past 16 KiB on
#: 32 KiB to 1 MiB of such texts joined by language. Between lengths the limits run straight over the logarithm.
#: Shorter texts are mostly frame header and have no limits; other languages and scripts need limits of their own.
CLEAN = (
    Band(128, 0.98, 1.30), Band(192, 1.19, 1.52), Band(256, 1.27, 1.62), Band(384, 1.35, 1.69), Band(512, 1.41, 1.77), Band(768, 1.52, 1.91), Band(1024, 1.67, 2.00), Band(1536, 1.79, 2.09),
    Band(2048, 1.89, 2.17), Band(3072, 1.96, 2.19), Band(4096, 2.05, 2.25), Band(6144, 2.15, 2.32), Band(8192, 2.21, 2.35), Band(12288, 2.25, 2.39), Band(16384, 2.29, 2.44), Band(32768, 2.40, 2.50),
    Band(65536, 2.54, 2.79), Band(1 << 20, 2.54, 2.85),
)
#: Margins on what was measured: below, where noise is far off, 8 %; above, where strewn symbols and tables begin, 3 %.
BELOW, ABOVE = 0.92, 1.03
#: Chunks get smaller with the text: from so many bytes on, chunks of so many bytes. A shorter text is one chunk.
CHUNK_BYTES = ((512, 256), (1024, 512), (8192, 1024), (32768, 4096))
#: A text goes when more than this share of its chunks is outside the limits of a document of their size.
CHUNK_SHARE = 0.25

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside at least one five-word window that stands twice or more in the text, first ones included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n <= 100_000:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        counts = Counter(grams)
        if len(counts) == n:
            return 0
        hit = np.fromiter((counts[g] > 1 for g in grams), bool, n)
    else:  # ranks of pairs, fours and fives: memory stays in proportion to the words
        ids: dict[bytes, int] = {}
        one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        two = np.unique(one[:-1] * len(ids) + one[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
        _, back, counts = np.unique(four[:n] * len(ids) + one[4:], return_inverse=True, return_counts=True)
        hit = counts[back] > 1
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n] += hit
    edge[WINDOW:] -= hit
    return int((np.cumsum(edge) > 0).sum())


def measure(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple:
    """The columns of :data:`COLUMNS` for one text."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ratio = len(raw) / len(packer.compress(raw)) if raw else 0.0
    starts, size = chunks_of(len(raw))
    bad = sum(not in_band(size / len(packer.compress(raw[at : at + size])), size) for at in starts)
    return (
        len(words), len(raw.translate(None, _SPACE + _NOT_STARTS)), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeat_words(words), ratio, len(starts), bad, len(raw),
    )


def chunks_of(n_bytes: int) -> tuple[list[int], int]:
    """Where the chunks start, and their size. The last is aligned to the end of the text, so every byte is in some chunk."""
    size = next((c for least, c in reversed(CHUNK_BYTES) if n_bytes >= least), n_bytes)
    starts = list(range(0, n_bytes - size + 1, size)) if n_bytes else []
    return starts + [n_bytes - size] * bool(starts and n_bytes % size), size


@lru_cache(maxsize=1 << 16)
def limits(n_bytes: int) -> tuple[float, float]:
    """The least and the greatest ratio allowed at a length."""
    if n_bytes < CLEAN[0].n_bytes:
        return 0.0, float("inf")
    at, known = math.log2(n_bytes), [math.log2(b.n_bytes) for b in CLEAN]
    return BELOW * float(np.interp(at, known, [b.lowest for b in CLEAN])), ABOVE * float(np.interp(at, known, [b.highest for b in CLEAN]))


def in_band(ratio: float, n_bytes: int) -> bool:
    lowest, highest = limits(n_bytes)
    return lowest <= ratio <= highest


def quality_rules(docs: DataFrame, text: str = "text", name: str = "rules") -> DataFrame:
    """``docs`` with the measurements, ``base_failed`` and ``kept``, added as one struct column ``name``; underscores follow the name until no column has it."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    own = numbered(docs)
    return _ruled(own, place(docs, text)).toDF(*docs.columns, name)


def _ruled(docs: DataFrame, text: str) -> DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}
    fields = [pa.field(c.split()[0], kinds[c.split()[1]]) for c in COLUMNS.split(", ")] + [pa.field("base_failed", pa.bool_()), pa.field("kept", pa.bool_())]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            rows = []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                *m, n_bytes = measure(raw or b"", packer)
                x = dict(zip(names, m, strict=True))
                x["base_failed"] = x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]
                x["kept"] = not x["base_failed"] and in_band(x["ratio"], n_bytes) and x["n_bad_chunks"] <= CHUNK_SHARE * x["n_chunks"]
                rows.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.struct(fields))], names=[*batch.schema.names, "rules"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"rules struct<{COLUMNS.replace(' ', ':').replace(',:', ',')},base_failed:boolean,kept:boolean>"])
    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only the rows the rules keep, with the columns of ``docs``."""
    return _ruled(numbered(docs), place(docs, text)).where("rules.kept").drop("rules").toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    done = quality_rules(docs.select("doc_id", "text"))
    return done.select("doc_id", *[F.col(f"rules.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks")])
