"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
#: Lists that note the folders that cut() writes, innermost last, by thread.
_noting = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where it is unset and
    the master is this machine, a temporary folder of our own that goes with the process. On a cluster
    an unset folder is an error: executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="crossloom-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends here, a lost executor
    costs no recomputation, and several readers share one computation.

    files: for narrow tables, at most so many files (and last tasks); small files cost more than their rows."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    for made in getattr(_noting, "lists", ()):
        made.append(path)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that cut() writes in this thread while the block runs, for drop()."""
    made: list[str] = []
    _noting.lists = [*getattr(_noting, "lists", ()), made]
    try:
        yield made
    finally:
        _noting.lists = [x for x in _noting.lists if x is not made]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables of cut() that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def purge(spark: SparkSession) -> None:
    """Removes every table that this application has written with cut()."""
    drop(spark, [f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"])
