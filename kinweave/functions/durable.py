"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the setting by which a query's shuffle files go when it is over, not when the driver happens to collect its garbage.
SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Hadoop paths of the tables written so far, with their file systems.
_WRITTEN: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set: a fresh local one in local mode, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns the written table.

    Runs ``df`` once; what it shuffled is off the disk when it is written. The result has no lineage, knows its size, and is read
    with column pruning. It stays until `release` or the end of the program.
    """
    spark = df.sparkSession
    name, was = reserved(spark), spark.conf.get(SWEPT, "false")
    spark.conf.set(SWEPT, "true")
    try:
        df.write.parquet(name)
    finally:
        spark.conf.set(SWEPT, was)
    return spark.read.schema(df.schema).parquet(name)


def reserved(spark: SparkSession) -> str:
    """A new path in the shared folder, for files that go when durable tables go."""
    name = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    _WRITTEN.append((path.getFileSystem(spark._jsc.hadoopConfiguration()), path))
    return name


def mark() -> int:
    """The number of durable tables so far, for `release`."""
    return len(_WRITTEN)


def release(since: int = 0, last: bool = True) -> None:
    """Deletes the durable tables written after `mark` gave ``since``; the last one only with ``last``.

    Call it when nothing reads them any more.
    """
    kept = [] if last else _WRITTEN[since:][-1:]
    while len(_WRITTEN) > since:
        files, path = _WRITTEN.pop()
        if (files, path) not in kept:
            files.delete(path, True)
    _WRITTEN.extend(kept)


@atexit.register
def _release_all() -> None:
    try:
        release()
    except Exception:  # the JVM is gone, and with it a local session's folder
        _WRITTEN.clear()
