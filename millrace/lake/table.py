"""A versioned table: Parquet files that never change, lists of them, and one small JSON manifest for each version.

A write puts new files below ``data/``, names them in a list, and commits the next manifest, which names
the lists of the version. A manifest is written under a temporary name and appears under its number
whole or not at all, and only if that number is not taken: of two writers one commits and the other
fails, a writer that dies leaves nothing that a reader sees. Merges and deletes rewrite the files that hold
a touched row; all others stay in the lists as they are. Files, lists and manifests go through Hadoop's
file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.dedupe import merge_newer
from millrace.operators.joins import broadcast_if_small, row_bytes
from millrace.sources import store

#: Lists that a version names before they are made one.
MOST_LISTS = 50
FILE_BYTES = 128 << 20


@dataclass
class LakeTable:
    spark: SparkSession
    path: str
    partition_by: tuple[str, ...] = ()

    def versions(self) -> list[int]:
        names = (f.name for f in store.listing(self.spark, f"{self.path}/_manifest"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version holds, the newest by default; ``files`` are those of all its lists."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        if version is None:
            return None
        if version not in known:
            raise ValueError(f"version {version} does not exist")
        m = json.loads(store.read_text(self.spark, f"{self.path}/_manifest/{version:08d}.json"))
        m["files"] = [f | {"list": name} for name in m["lists"] for f in json.loads(store.read_text(self.spark, f"{self.path}/_lists/{name}.json"))]
        return m

    def _commit(self, files: list[dict], schema: T.StructType, operation: str, base: int | None, **details) -> int:
        """The next version. Lists of the version before whose files all stay are kept; the other files go into a new one."""
        version = 0 if base is None else base + 1
        sizes: dict[str, int] = {}
        for f in self.manifest(base)["files"] if base is not None else []:
            sizes[f["list"]] = sizes.get(f["list"], 0) + 1
        staying: dict[str, int] = {}
        for f in files:
            if "list" in f:
                staying[f["list"]] = staying.get(f["list"], 0) + 1
        kept = [name for name, n in staying.items() if sizes.get(name) == n]
        if len(kept) >= MOST_LISTS:
            kept = []
        rest = [{k: v for k, v in f.items() if k != "list"} for f in files if f.get("list") not in kept]
        if rest:
            kept.append(uuid.uuid4().hex)
            store.write_text(self.spark, f"{self.path}/_lists/{kept[-1]}.json", json.dumps(rest))
        body = {"version": version, "operation": operation, "schema": json.loads(schema.json()), "partition_by": list(self.partition_by), "lists": kept, "n_files": len(files), "bytes": sum(f["bytes"] for f in files), **details}
        try:
            store.write_text(self.spark, f"{self.path}/_manifest/{version:08d}.json", json.dumps(body, sort_keys=True))
        except FileExistsError as e:
            raise FileExistsError(f"version {version} exists already: another writer was first") from e
        return version

    def _put(self, df: DataFrame) -> list[dict]:
        """The files of a new write. They are written apart and then moved beside the others, so that one reader takes all."""
        folder = f"{self.path}/data/_{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(folder)
        out = []
        for f in store.walk(self.spark, folder):
            if f.name.endswith(".parquet"):
                place = f.path[f.path.index(folder.rsplit("/", 1)[1]) + 34 :]
                store.move(self.spark, f.path, f"{self.path}/data/{place}")
                out.append({"path": f"data/{place}", "bytes": f.bytes})
        store.delete(self.spark, folder)
        return out

    def read(self, version: int | None = None, files: list[dict] | None = None) -> DataFrame:
        """The rows of a version, the newest by default: one scan, however many writes made it."""
        m = self.manifest(version)
        if m is None:
            raise ValueError("the table has no version yet")
        schema = T.StructType.fromJson(m["schema"])
        chosen = m["files"] if files is None else files
        if not chosen:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if m["partition_by"]:  # partition columns come from the path
            reader = reader.option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/{f['path']}" for f in chosen]).select(*schema.names)

    def _holding(self, m: dict, rows: Callable[[DataFrame], DataFrame]) -> list[dict]:
        """The files of a version that have rows left after ``rows``. Reads only the columns that this needs."""
        if not m["files"]:
            return []
        hit = rows(self.read(files=m["files"]).withColumn("__file", F.col("_metadata.file_path"))).select("__file").distinct()
        paths = {unquote(r[0]) for r in hit.collect()}
        paths = {p[p.rindex("/data/") + 1 :] for p in paths}
        return [f for f in m["files"] if f["path"] in paths]

    def update(self, batch: DataFrame, keys: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame], operation: str, **details) -> int:
        """``combine`` of the rows in files that hold a key of the batch, and the batch, in place of these files. Null keys meet nothing."""
        m = self.manifest()
        if m is None:
            raise ValueError("the table has no version yet")
        wanted = batch.select(*keys).distinct()
        span = wanted.agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high"), F.sum(row_bytes(wanted)).alias("bytes")).first()
        small = broadcast_if_small(wanted, measured=span["bytes"] or 0)
        met = wanted.hint("merge") if small is wanted else small  # else Spark may broadcast it by the size of its files
        near = F.col(keys[0]).between(F.lit(span["low"]), F.lit(span["high"]))  # row groups outside are skipped by their statistics
        touched = self._holding(m, lambda df: df.where(near).join(met, keys, "left_semi"))
        gone = {f["path"] for f in touched}
        new = combine(self.read(files=touched), batch).select(*T.StructType.fromJson(m["schema"]).names)
        return self._commit([f for f in m["files"] if f["path"] not in gone] + self._put(new), T.StructType.fromJson(m["schema"]), operation, m["version"], **details)

    def overwrite(self, df: DataFrame, operation: str = "overwrite") -> int:
        versions = self.versions()
        return self._commit(self._put(df), df.schema, operation, versions[-1] if versions else None)

    def append(self, df: DataFrame) -> int:
        """Adds rows; the schema must be the table's."""
        m = self.manifest()
        if m is None:
            return self.overwrite(df, "append")
        schema = T.StructType.fromJson(m["schema"])
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"schema {df.schema.simpleString()} is not the table's {schema.simpleString()}")
        return self._commit(m["files"] + self._put(df), schema, "append", m["version"])

    @staticmethod
    def _partition(path: str) -> dict[str, str]:
        return dict(x.split("=", 1) for x in path.split("/") if "=" in x)

    def overwrite_partitions(self, df: DataFrame) -> int:
        """Replaces the partitions that ``df`` has rows of; all others keep their files."""
        m = self.manifest()
        if m is None:
            return self.overwrite(df, "overwrite_partitions")
        new = self._put(df)
        touched = {tuple(sorted(self._partition(f["path"]).items())) for f in new}
        kept = [f for f in m["files"] if tuple(sorted(self._partition(f["path"]).items())) not in touched]
        return self._commit(kept + new, df.schema, "overwrite_partitions", m["version"])

    def merge(self, batch: DataFrame, keys: list[str], version: str, strict: bool = True) -> int:
        """Update if newer, insert if new; the batch holds a key once. Keys keep to the newest state, wherever it stood."""
        m = self.manifest()
        if m is None:
            return self.overwrite(batch, "merge")
        return self.update(batch, keys, lambda old, new: merge_newer(old, new.select(*old.columns), keys, version, strict), "merge")

    def delete_where(self, condition: str) -> int:
        """Retention and erasure: rewrites the files with rows that meet a condition, without these."""
        m = self.manifest()
        touched = self._holding(m, lambda df: df.where(condition))
        gone = {f["path"] for f in touched}
        new = self._put(self.read(files=touched).where(f"NOT coalesce({condition}, false)")) if touched else []
        return self._commit([f for f in m["files"] if f["path"] not in gone] + new, T.StructType.fromJson(m["schema"]), "delete", m["version"], condition=condition)

    def publish(self, df: DataFrame) -> tuple[int, bool]:
        """Overwrite only if the content differs: the digest of all rows, in any order, is kept in the manifest."""
        row = F.xxhash64(F.to_json(F.struct(*df.columns)))
        low, high = row.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(row, 33)
        digest = ":".join(str(x) for x in df.agg(F.count("*"), F.sum(low), F.sum(high), F.bit_xor(row)).first())
        m = self.manifest()
        if m and m.get("digest") == digest:
            return m["version"], False
        return self._commit(self._put(df), df.schema, "publish", m["version"] if m else None, digest=digest), True

    def compact(self, files_per_partition: int = 1, file_bytes: int = FILE_BYTES) -> dict:
        """Fewer files for each partition, the same rows; a partition of more than ``file_bytes`` a file gets more of them."""
        m = self.manifest()
        df = self.read()
        before = len(m["files"])
        largest = max((p["bytes"] for p in self.inventory()), default=0)
        files = max(files_per_partition, math.ceil(largest / file_bytes))
        salt: list[Column] = [F.pmod(F.xxhash64(*df.columns), F.lit(files))] if files > 1 else []
        df = df.repartition(*self.partition_by, *salt) if self.partition_by else df.repartition(files)
        new = self._put(df)
        self._commit(new, df.schema, "compact", m["version"])
        return {"partitions": len({tuple(self._partition(f["path"]).items()) for f in new}), "before": before, "after": len(new), "rows": self.read().count()}

    def cluster(self, columns: list[str], files: int = 8) -> int:
        """Rewrites the table in ranges of some columns, so that file statistics prune on them."""
        m = self.manifest()
        df = self.read().repartitionByRange(files, *columns).sortWithinPartitions(*columns)
        return self._commit(self._put(df), df.schema, "cluster", m["version"])

    def restore(self, version: int) -> int:
        m, old = self.manifest(), self.manifest(version)
        return self._commit(old["files"], T.StructType.fromJson(old["schema"]), "restore", m["version"], restored=version)

    def history(self) -> list[dict]:
        return [{k: m[k] for k in ("version", "operation")} | {"files": len(m["files"]), "bytes": m["bytes"]} for m in map(self.manifest, self.versions())]

    def vacuum(self, keep_versions: int = 1, dry_run: bool = True, grace_hours: float = 24.0) -> list[str]:
        """Files that none of the last versions names; deleted unless it is a dry run. Older versions' manifests and lists go too.

        A file that no version ever named may belong to a writer who has not committed yet: it is left alone for ``grace_hours``.
        """
        known = self.versions()
        kept, old = [self.manifest(v) for v in known[-keep_versions:]], [self.manifest(v) for v in known[:-keep_versions]]
        needed, once = ({f["path"] for m in ms for f in m["files"]} for ms in (kept, old))
        before = (time.time() - grace_hours * 3600) * 1000
        found = [(f.path[f.path.rindex("/data/") + 1 :], f.modified) for f in store.walk(self.spark, f"{self.path}/data")]
        extra = sorted(path for path, modified in found if path not in needed and (path in once or modified < before))
        if not dry_run:
            lists = {x for m in kept for x in m["lists"]}
            for name in [*extra, *(f"_manifest/{m['version']:08d}.json" for m in old), *(f"_lists/{x}.json" for m in old for x in m["lists"] if x not in lists)]:
                store.delete(self.spark, f"{self.path}/{name}")
        return extra

    def pruning(self, column: str, low: str, high: str) -> dict:
        """Files in all and files read for an inclusive range of a partition column, from the manifest alone."""
        files = self.manifest()["files"]
        hit = [f for f in files if low <= self._partition(f["path"]).get(column, low) <= high]
        return {"files_total": len(files), "files_scanned": len(hit), "files_skipped": len(files) - len(hit)}

    def inventory(self) -> list[dict]:
        """Files and bytes of each partition, without opening any."""
        out: dict[str, dict] = {}
        for f in self.manifest()["files"]:
            name = "/".join(f"{k}={v}" for k, v in self._partition(f["path"]).items())
            row = out.setdefault(name, {"partition": name, "files": 0, "bytes": 0})
            row["files"] += 1
            row["bytes"] += f["bytes"]
        return [out[k] for k in sorted(out)]
