"""Small files through the Hadoop file system, so that any shared store works."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = located(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, path: str) -> bytes:
    fs, p = located(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = located(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, data: bytes) -> bool:
    """Whole or not at all, and only if the name is free: written aside, then renamed.  False if it is taken.

    The store's rename must be atomic and refuse a name that is taken, as HDFS and
    local file systems do.  An object store that copies instead needs a file
    system that makes up for it; two writers at once could else both succeed.
    """
    aside = f"{path}.{spark._jvm.java.util.UUID.randomUUID().toString()}.tmp"
    write(spark, aside, data)
    fs, a = located(spark, aside)
    _, b = located(spark, path)
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
    except Exception:
        fs.delete(a, False)
        if fs.exists(b):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, p = located(spark, path)
    fs.delete(p, True)


def shared(spark: SparkSession, name: str) -> str:
    """A new location below ``spark.checkpoint.dir``; a local temporary one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
