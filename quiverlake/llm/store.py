"""Shared working folders, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with a few fixed-width columns may be broadcast (about 64 MB hashed).
BROADCAST_ROWS = 1_000_000
#: Rows and bytes that an Arrow batch holds at most (one row at least); kernels cut batches further.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a local temporary folder only where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quiverlake-")
        _roots[app] = f"{base.rstrip('/')}/quiverlake-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone already when Python exits
        pass


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a location."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """The same rows, read again from a table in the shared folder: lineage ends here and survives lost executors.

    files: tables of a few narrow rows come in this many files at most, which spares the store many tiny ones.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if files:
        df = df.coalesce(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; without it Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts or messages must fit beside the JVM's heap."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt to all cores if it comes in a few partitions only; as it is otherwise.

    Rows go by a hash of ``columns`` and stay in its order, so that a task that
    runs again sees the same rows in the same order.
    """
    cores, now = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if now > 8 or 2 * now > cores:
        return df
    return df.withColumn("_deal", F.xxhash64(*columns)).repartition(cores, "_deal").sortWithinPartitions("_deal").drop("_deal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ... by place, so that no name of theirs can clash with one of ours."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The numbered name of a column."""
    return f"c{[c.lower() for c in docs.columns].index(name.lower())}"


def named(df: DataFrame, docs: DataFrame, added: list[str]) -> DataFrame:
    """From numbered() back to the columns of ``docs``, and after them ``added``; an added name that is taken gets underscores at its end."""
    out = df.select(*[f"c{i}" for i in range(len(docs.columns))], *added)
    taken, names = {c.lower() for c in docs.columns}, []
    for name in added:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return out.toDF(*docs.columns, *names)
