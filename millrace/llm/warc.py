"""A deterministic, sharded WARC writer, and a reader.

Records are dealt out by ranges of page id and sorted, so an archive's content depends on the pages
alone: the number of shards comes from the sum of payload bytes, and the bounds between them from the
sorted ids of a sample that digests choose, not a random seed. Each shard rolls its files by compressed size; every record is a gzip member of its own, with
headers and digests made anew, dates and ids derived from content. A file is written under a
temporary name that holds the task's attempt and renamed when it is whole; attempts of the same task
write the same bytes, so a lost executor or a speculative copy changes nothing. The archive counts as
written once its manifest, a Parquet table of names, sizes and digests, is committed; readers take
only the files it names.

Records of equal payloads refer to the one with the largest page id (``revisit``). Which those are is
found on digests alone; the answers travel as rows of their own in the same exchange as the pages, so
a payload is shuffled once and a very common one is not gathered anywhere.

Defined results: a null html is an empty payload; a null url gets a ``urn:page:`` target; control
characters in a url are percent-encoded; pages of a null id refer to the largest id of their
payload, and are responses if there is none; rows that repeat id and payload are all responses if that
id is the largest; payloads under ``min_bytes`` are all responses; an empty table writes no file. A very
long payload is one record, held whole while it is written and read; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialised, scratch_path

ROLL_BYTES = 64 << 20
#: Payload bytes of a shard: the first number until there are ``MANY`` shards, then up to the second.
SHARD_BYTES, MOST_SHARD_BYTES, MANY = 8 << 20, 8 << 30, 4096
#: Ids in the sample for each shard.
SAMPLED = 32
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "name string, records long, bytes long, sha1 string"
_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(kind: str, id: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": id, "WARC-Date": DATE, **fields, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32_sha1(payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload))}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return _record("response", record_id(page_id, digest), fields, http + payload)
    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
    return _record("revisit", record_id(page_id, digest), fields, http)


class _Shards:
    """The files of one task, shard by shard: whole ones are renamed into place."""

    def __init__(self, uri: str, attempt: int, roll: int):
        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.shard, self.attempt, self.roll, self.n, self.out = None, attempt, roll, 0, None
        self.done: list[dict] = []

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.n = shard, 0
        if self.out is None:
            self.fs.create_dir(self.root)
            self.name = f"pages-{shard:05d}-{self.n:05d}.warc.gz"
            self.tmp = f"{self.root}/_temporary-{self.name}-{self.attempt}"
            self.out = self.fs.open_output_stream(self.tmp, compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha1(usedforsecurity=False)
            self._put(_record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>", {"WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sha.update(raw)
        self.bytes += len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, f"{self.root}/{self.name}")
            self.done.append({"name": self.name, "records": self.records, "bytes": self.bytes, "sha1": self.sha.hexdigest()})
            self.out, self.n = None, self.n + 1


def _payload(html: str) -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, digest, last``: the pages (with ``digest``, ``n``) whose payload stands in a page of a larger id, ``last``."""
    meta = pages.where(F.col("n") >= min_bytes).select("page_id", "digest")
    last = meta.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1 and last is not null").select("digest", "last")
    return meta.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("last"))).select("page_id", "digest", "last").distinct()


def bounds(meta: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple[int | None, str]]:
    """The first ``page_id, digest`` of each shard but the first, for pages (with ``digest``, ``n``). They depend on these rows alone, however they are dealt out."""
    total, rows = meta.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(min(math.ceil(total / shard_bytes), MANY), math.ceil(total / MOST_SHARD_BYTES), 1)
    share = min(1.0, SAMPLED * shards / max(rows, 1))
    lot = F.pmod(F.xxhash64("digest", "page_id"), F.lit(1 << 30))
    sample = meta.where(lot < F.lit(math.ceil(share * (1 << 30)))).select("page_id", "digest").distinct()
    ids = sorted(map(tuple, sample.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) if shards > 1 else []
    return sorted({ids[len(ids) * i // shards] for i in range(1, shards)}, key=ids.index) if ids else []


def shard_of(page_id: Column, digest: Column, firsts: list[tuple[int | None, str]]) -> Column:
    """How many of the bounds are not after a page: found among the first of each stretch, and then within one."""
    if not firsts:
        return F.lit(0)
    step = math.isqrt(len(firsts)) + 1
    stretches = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    kind = "array<array<struct<page_id:bigint,digest:string>>>"
    table = F.from_json(F.lit(json.dumps([[{"page_id": p, "digest": d} for p, d in s] for s in stretches])), kind)
    own = F.struct(page_id.alias("page_id"), digest.alias("digest"))
    before = F.size(F.filter(table, lambda s: s[0] <= own))  # stretches that begin at the page or before it
    within = F.size(F.filter(F.element_at(table, before), lambda b: b <= own))
    return F.when(before == 0, 0).otherwise((before - 1) * step + within)


def write(pages: DataFrame, path: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives below ``path``; the manifest."""
    spark = pages.sparkSession
    payload = _payload("html")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    meta = materialised(own.select("page_id", "digest", "n"), "pages")
    firsts = bounds(meta, shard_bytes)
    marks = revisits(meta, min_bytes)
    rows = own.select("page_id", "digest", F.lit(True).alias("page"), "url", "payload", F.lit(None).cast("long").alias("last"))
    rows = rows.unionByName(marks.select("page_id", "digest", F.lit(False).alias("page"), "last"), allowMissingColumns=True)
    rows = rows.select(shard_of(F.col("page_id"), F.col("digest"), firsts).alias("shard"), *rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(path, TaskContext.get().taskAttemptId(), roll_bytes)
        key, last = None, None
        for batch in batches:
            for shard, page_id, digest, page, url, raw, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page_id, digest) != key:
                    key, last = (page_id, digest), None
                if not page:
                    last = refers
                    continue
                shards.add(shard, page_record(page_id, url, raw, last))
        shards.close()
        if shards.done:
            yield pa.RecordBatch.from_pylist(shards.done)

    ranged = rows.repartitionById(len(firsts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "page", "url")
    ranged.mapInArrow(run, _MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each gzip member of an archive; one record is in memory at a time."""
    feed, rest = zlib.decompressobj(31), b""
    parts: list[bytes] = []
    while rest or (rest := stream.read(1 << 20)):
        parts.append(feed.decompress(rest))
        rest = feed.unused_data
        if feed.eof:
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, body[: int(fields["Content-Length"])]
            feed, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files that the manifest names, one row each; digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or fields["WARC-Type"] == "response" and digest != base32_sha1(payload):
                            raise ValueError(f"a digest in {name} differs from its record")
                        refers = fields.get("X-Refers-To-Page")
                        rows.append({"page_id": int(p) if (p := fields["X-Page-Id"]) else None, "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None, "payload": payload if fields["WARC-Type"] == "response" else None})
                        held += len(payload)
                        if held > (8 << 20) or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, _ROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROW)

    names = manifest(spark, path).select("name")
    files = names.count()
    return names.repartition(max(1, min(files, 10_000)), "name").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def report(pages: DataFrame) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hex digits are four digits of base 32.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM l"""
