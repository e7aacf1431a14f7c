"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def row_key(id: Column, text: Column) -> Column:
    """What tells rows apart where ids are null or repeat: a digest of id and text."""
    name = F.coalesce(F.concat(F.lit("="), id.cast("string")), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.sha2(F.coalesce(text, F.lit("")), 256), name), 256))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... by place: whatever they were called, no name clashes with a helper's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """The name that a column of ``df`` has in :func:`numbered`: an exact match first, else one in other case."""
    names = df.columns
    return f"c{names.index(column) if column in names else [n.lower() for n in names].index(column.lower())}"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _OWN["dir"].removeprefix("file://"), ignore_errors=True)
    return _OWN["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    if path.startswith("file:"):  # on a local disk they go with this process; a cluster's store has its own expiry
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a :func:`materialised` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace/" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
