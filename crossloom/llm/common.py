"""Small helpers that the corpus operators share: tables, shared scratch space, batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from crossloom.operators.scratch import cut, fresh_path, purge, shared_dir  # noqa: F401

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch of rows that a task hands to Python at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to BATCH_BYTES, so that long texts don't fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of an application, once, for those that don't have it installed."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parents[2]
    if app in _shipped:
        return
    at = tempfile.mkdtemp(prefix="crossloom-")  # the driver serves it from here as long as it lives
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    path = Path(at) / "crossloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "crossloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
