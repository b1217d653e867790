"""Where intermediate tables go.

Some jobs need one evaluation of a plan to be final: row positions after a sort, scores that
are read twice. Such results go to storage that all executors share, so a lost executor never
changes or loses them. Tables are written as Parquet, so that later passes read only the columns
they need; short lists are checkpointed.

Tables made inside ``with scratch(spark) as made:`` are deleted when the block ends. A table that
a result still reads lives until ``release(table)`` or the end of the Python process.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; without it, one beside the warehouse's tables.

    Without the setting, a warehouse on the driver's own disk will do on a single machine only.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    folder = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    if not named and not context.master.startswith("local") and folder.startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """For tasks: the file system of a path in the shared folder, and the path in it; also for Hadoop's file:/path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def stage(df: DataFrame) -> DataFrame:
    """Evaluate a short result once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, kind: str = "table") -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path for files that a job writes by itself; deleted with the process."""
    path = new_path(spark, kind)
    _kept[path] = spark
    return path


def stage_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Each partition of ``df`` is a file whose name holds the partition's number.
    """
    spark = df.sparkSession
    path = new_path(spark)
    _kept[path] = spark
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def stage_lines(df: DataFrame) -> str:
    """Write texts to the shared folder, a line each, and return the path; deleted with the process."""
    path = new_folder(df.sparkSession, "lines")
    df.write.text(path)
    return path


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "staged_path", None)
        if path in _kept:
            delete_folder(_kept.pop(path), path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Gives a function like ``stage_table``; what it has written is deleted when the block ends."""
    made: list[DataFrame] = []

    def table(df: DataFrame) -> DataFrame:
        made.append(stage_table(df))
        return made[-1]

    try:
        yield table
    finally:
        release(*made)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_kept.items()):
        try:
            delete_folder(spark, path)
        except Exception:  # the session has ended before the process
            return


def spread_out(staged: DataFrame) -> DataFrame:
    """Give a small staged table as many partitions as there are cores, for costly work per row."""
    cores = staged.sparkSession.sparkContext.defaultParallelism
    return stage_table(staged.repartition(cores)) if staged.rdd.getNumPartitions() < cores else staged
