"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of their id, sorted, encoded where they stand, and written with
Spark's ORC writer: one file per range, stripes of a set size, a row index entry every
``STRIDE`` rows and a Bloom filter on the id. Readers take stripes in parallel and skip files,
stripes and row groups by the id's statistics. ``shard`` and ``pos`` hold the place of a document in
the whole order, so the running start of its ids is a sum over shards and a sum within one.

Encoding goes through the tokenizers library. Where the tokenizer's own configuration shows that no
token spans white space (checked against the file, not assumed), the different words of a few megabytes
of texts are encoded once, through a bounded cache, and their ids laid out by place with array
operations; any other tokenizer encodes whole texts.

Defined results: a null text is empty and encodes to the end id alone; a null id sorts first; rows
that repeat an id follow each other in the order of their text; a very long text is encoded whole, in a
batch of its own; other columns are not read; an empty table writes no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import scratch_path

END_ID = 2
STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: What the cache holds at most.
CACHE_WORDS = 700_000
#: Texts are encoded together until they have so many bytes.
TOGETHER = 4 << 20

_SEPARABLE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: Most words: letters that are already normal (NFC) and lower-case one by one, perhaps with a mark after them. The letters
#: are one piece, and so is the mark; other words go through the library whole.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([][.,;:!?)(*#$%&|\"]?)")


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Recent:
    """Words with their ids, at most ``most``, in flat arrays: some tens of bytes a word, several times less than as objects.

    When there is no room, words that were not met since the last time go.
    """

    def __init__(self, most: int):
        self.most = most
        self._hold(pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _hold(self, words: pa.BinaryArray, size: np.ndarray, ids: np.ndarray) -> None:
        self.words, self.size, self.ids = words, size, ids
        self.first, self.met = np.cumsum(size) - size, np.zeros(len(size), bool)

    def find(self, words: pa.BinaryArray) -> np.ndarray:
        """The places of words, -1 where one is not known."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        self.met[at[at >= 0]] = True
        return at

    def put(self, new: dict[bytes, bytes]) -> None:
        """Adds words that are not known yet, as many as there is room for."""
        pairs = [(w, x) for w, x in new.items() if len(w) <= 64 and len(x) <= 256][: self.most]
        words, size, ids = self.words, self.size, self.ids
        if len(words) + len(pairs) > self.most:
            keep = self.met & (np.cumsum(self.met) <= max(self.most // 2, self.most - len(pairs)))
            words, ids, size = words.filter(pa.array(keep)), ids[np.repeat(keep, size)], size[keep]
            pairs = pairs[: self.most - len(words)]
        more = np.fromiter((len(x) // 4 for _, x in pairs), np.int64, len(pairs))
        ids = np.concatenate([ids, np.frombuffer(b"".join(x for _, x in pairs), "<u4")])
        met = self.met if len(words) == len(self.met) else np.zeros(len(words), bool)
        self._hold(pa.concat_arrays([words, pa.array([w for w, _ in pairs], pa.binary())]), np.concatenate([size, more]), ids)
        self.met[: len(met)] = met


class Encoder:
    """Texts to ids (little-endian, unsigned, 32 bits each)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        marks = [t["content"] for t in config["added_tokens"]]
        special = [t for t in config["added_tokens"] if t["special"]]
        self.mark = (special[0]["content"], special[0]["id"]) if special else None
        self.separable = (config["normalizer"], config["pre_tokenizer"]) == _SEPARABLE and all(m.startswith("<|") and not re.search(r"\s", m) for m in marks)
        suffix = config["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.known = Recent(CACHE_WORDS)

    def whole(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pieces(self, pieces: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of words of plain letters that are known, and of the others: these go through the library together, and come apart where a piece ends."""
        at = self.known.find(pa.array([p.encode() for p in pieces], pa.binary())).tolist()  # a piece is a word as well
        raw, first, size = self.known.ids, self.known.first, self.known.size
        known = {p: raw[first[i] : first[i] + size[i]].tobytes() for p, i in zip(pieces, at, strict=True) if i >= 0}
        unknown, found = [p for p, i in zip(pieces, at, strict=True) if i < 0], {}
        for at in range(0, len(unknown), 50_000):
            some = unknown[at : at + 50_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                new = {p: raw[a:b] for p, a, b in zip(some, [0, *ends], ends, strict=False)}
            else:
                new = {p: self.whole(p) for p in some}
            found |= new
        return known, found

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, and of the pieces that some of them begin with."""
        bare, marked, rest = {}, {}, []
        for raw in words:
            if raw.isalpha():  # ASCII letters only
                bare[raw] = raw.lower().decode()
            elif parts := _SIMPLE.fullmatch(raw.decode()):
                letters, mark = parts.groups()
                if mark:
                    marked[raw] = letters.lower(), mark
                else:
                    bare[raw] = letters.lower()
            else:
                rest.append(raw)
        known, fresh = self._pieces(list(dict.fromkeys([*bare.values(), *(p for p, _ in marked.values())])))
        pieces = known | fresh
        marks = {m: self.whole(m) for m in {m for _, m in marked.values()}}
        found = {p.encode(): ids for p, ids in fresh.items()} | {raw: pieces[p] for raw, p in bare.items()}
        found.update((raw, pieces[p] + marks[m]) for raw, (p, m) in marked.items())
        return found | self._odd(rest)

    def _odd(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of any words, together: a special token stands between two words."""
        plain = [raw for raw in words if b"<|" not in raw]
        found = {raw: self.whole(raw.decode()) for raw in words if b"<|" in raw or self.mark is None}
        for at in range(0, len(plain) if self.mark else 0, 50_000):
            some = plain[at : at + 50_000]
            text, id = self.mark
            ids = np.array(self.tokenizer.encode_batch_fast([f" {text} ".join([*(w.decode() for w in some), ""])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == id)
            starts = np.concatenate([[0], ends[:-1] + 1])
            assert len(ends) == len(some)
            raw, a, b = ids.tobytes(), (4 * starts).tolist(), (4 * ends).tolist()
            found.update((w, raw[i:j]) for w, i, j in zip(some, a, b, strict=True))
        return found

    def encode(self, raw: bytes) -> bytes:
        return self.encode_all(pa.array([raw.decode()]), None)[1].tobytes()

    def encode_all(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids start (and the end of all), and all ids; each text ends in ``end_id`` unless that is None."""
        end = b"" if end_id is None else _as_bytes([end_id])
        texts = texts.fill_null("")
        if not self.separable:
            each = [self.whole(t) + end for t in texts.to_pylist()]
            return np.cumsum([0, *(len(x) // 4 for x in each)]), np.frombuffer(b"".join(each), "<u4")
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        places = split.flatten().dictionary_encode()
        words = places.dictionary.cast(pa.binary())
        known = self.known.find(words)
        first, size = np.zeros((2, len(words) + 1), np.int64)  # of each word's ids; the last is the end
        first[:-1][known >= 0], size[:-1][known >= 0], flat = self.known.first[known[known >= 0]], self.known.size[known[known >= 0]], self.known.ids
        unknown = words.filter(pa.array(known < 0)).to_pylist()
        new = self._words(unknown)
        ids = [*(new.get(w, b"") for w in unknown), end]
        lacking = np.append(known < 0, True)
        size[lacking] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first[lacking] = len(flat) + np.cumsum(size[lacking]) - size[lacking]
        flat = np.concatenate([flat, np.frombuffer(b"".join(ids), "<u4")])
        self.known.put(new)
        order = np.insert(places.indices.to_numpy(), bounds[1:] - bounds[0], len(words))  # the end after each text's words
        count = size[order]
        at = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(first[order] - at[:-1], count)
        place += np.arange(len(place))
        return at[bounds - bounds[0] + np.arange(len(bounds))], flat[place]


def together(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most_bytes`` together, one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, so that its cache lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id, shard, pos, tokens``, sorted by id within shards and from shard to shard."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, pos = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in together(batch, 1, TOGETHER):
                offsets, ids = encoder.encode_all(part.column(1), end_id)
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(pos, pos + n)), tokens], names=["doc_id", "shard", "pos", "tokens"])
                pos += n

    chosen = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ranged = chosen.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return ranged.mapInArrow(run, f"doc_id {kind}, shard int, pos long, tokens array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, **columns: str) -> None:
    """Encode and write ``docs`` as ORC files at ``path``."""
    out = encode(docs, tokenizer, **columns).write.option("compression", "zstd")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "orc.create.index": "true"}
    out.options(**options).orc(path)


def read(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """The rows of the files; ``ids`` goes to the reader, which skips by statistics and Bloom filters."""
    df = spark.read.orc(path)
    return df if ids is None else df.where(F.col("doc_id").isin(ids))


def digest(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of files that :func:`read` has opened."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            crc = [zlib.crc32(values[a:b].astype("<i4", copy=False).tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "shard", "pos", "n_tokens", "ids_crc32"])

    each = tokens.select("doc_id", "shard", "pos", "tokens").mapInArrow(run, f"doc_id {kind}, shard int, pos long, n_tokens long, ids_crc32 long")
    return each


def starts(each: DataFrame) -> DataFrame:
    """Adds ``start`` from the counts of whole shards and of those before in the same shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    shards = each.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return each.join(shards, "shard").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` below the shared folder, and digest what the files hold."""
    from millrace.llm.common import materialised

    path = scratch_path(docs.sparkSession, "orc")
    write(docs, path, tokenizer)
    each = materialised(digest(read(docs.sparkSession, path)), "token-digest")
    return starts(each).select("doc_id", "start", "n_tokens", "ids_crc32")


def report(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
