"""What the learned document operators share: the bounded labelled sample, and one-pass scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_batches

#: Labelled rows that a model is fitted on, at most. A bound of the driver's memory, not of the data scored.
SAMPLE_ROWS = 20_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, target: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE_ROWS, train: Column | None = None, each: dict[int, int] | None = None) -> DataFrame:
    """doc_id, text and label of at most `limit` labelled documents, picked by hash of the id; with
    `each` at most so many of each label that it names.

    Labels that are null or without id don't count; of several labels for an id the largest counts.
    The picked ids are at most `limit` rows, which is why they may be broadcast."""
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if train is not None:
        marks = marks.where(train)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in (each or {}).items()]
    marks = reduce(DataFrame.union, parts) if parts else marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(marks), "doc_id")


def add_columns(df: DataFrame, text: str, compute: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """df with columns that compute() makes from a batch of the text column; no shuffle."""
    bounded_batches(df.sparkSession)
    names, at = [f.name for f in fields], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch.column(at))], [*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def filter_texts(docs: DataFrame, text: str, verdict: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs whose text verdict() finds good, with docs' own columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdict(batch.column(at)), pa.bool_()))

    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    return docs.mapInArrow(run, docs.schema)


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most `bins` bins with about as many rows each; bin b holds edge[b-1] < x <= edge[b]."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
