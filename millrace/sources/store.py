"""Small files on any store that Hadoop's file systems reach: listed, read, moved, and written whole or not at all."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Found:
    path: str
    bytes: int
    modified: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[1]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/") if found else "file://" + tempfile.mkdtemp(prefix="millrace-")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _found(status) -> Found:
    return Found(status.getPath().toString(), status.getLen(), status.getModificationTime())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, folder: str) -> list[Found]:
    """The files in a folder; none if there is no such folder."""
    fs, p = _fs(spark, folder)
    return [_found(s) for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []


def walk(spark: SparkSession, folder: str) -> list[Found]:
    """The files in a folder and those below it."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        out.append(_found(files.next()))
    return out


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_bytes(spark: SparkSession, path: str, content: bytes, replace: bool = False) -> None:
    """A file that appears whole: written beside its place, then moved there. If it is there already, ``FileExistsError`` unless it may be replaced."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    tmp, q = _fs(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")
    out = tmp.create(q, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    try:
        _appear(spark, fs, q, p, replace)
    finally:
        tmp.delete(q, False)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    write_bytes(spark, path, text.encode(), replace)


def _appear(spark: SparkSession, fs, source, target, replace: bool) -> None:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        if fs.getUri().getScheme() == "file" and not replace:  # a link to a taken name fails; a local move would overwrite
            java = jvm.java.nio.file
            as_path = lambda p: java.Paths.get(p.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0))
            java.Files.createLink(as_path(target), as_path(source))
            return
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(source), fs.makeQualified(target), options)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(f"{target.toString()} exists already") from e
        raise


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, target)
    fs.mkdirs(p.getParent())
    if not fs.rename(_fs(spark, source)[1], p):
        raise OSError(f"could not move {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
