"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where it is unset, a session on one machine makes a temporary folder once; on a cluster that is an error, as every
    executor would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siftstone.shared", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="siftstone-")
        spark.conf.set("siftstone.shared", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, whatever file system holds it."""
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def make(spark: SparkSession, path: str) -> None:
    """A folder, which may be there already."""
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether old is now new; false if new was there already."""
    p, fs = _hadoop(spark, old)
    q, _ = _hadoop(spark, new)
    return not fs.exists(q) and fs.rename(p, q)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    p, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def version(table: DataFrame) -> str:
    """A number that changes when a table's files do: their paths, lengths and times."""
    spark = table.sparkSession
    said = []
    for f in sorted(table.inputFiles()):
        p, fs = _hadoop(spark, f)
        s = fs.getFileStatus(p)
        said.append(f"{f}|{s.getLen()}|{s.getModificationTime()}")
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(said)).hex
