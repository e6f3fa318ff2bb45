"""Positions 0, 1, 2, ... in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossloom.operators.scratch import cut

#: Up to so many rows are numbered in one window; more by a distributed sort.
ONE_WINDOW = 200_000


def numbered(df: DataFrame, order: list[Column], name: str, *, size: int | None = None) -> DataFrame:
    """df with its rows' positions in the order.

    Beyond ONE_WINDOW rows a distributed sort numbers the rows of each range, and the ranges' counts (a
    row per partition) give the offsets; no task then sees all rows. The sorted rows are written to the shared
    folder: sorted anew, they might fall into other ranges than were counted."""
    if size is None or size <= ONE_WINDOW:
        return df.withColumn(name, (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("long"))
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).drop("_n")
    joined = placed.join(F.broadcast(before), part == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
