"""The cells of a pivot over an append-only stream of timed records, window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crossloom.functions.labels import SCALE, label, measure
from crossloom.operators.aggregate import aggregate, column_names, row_names, value_names
from crossloom.operators.filters import _quoted, accepts
from crossloom.plans.request import PivotRequest


def windowed_cells(stream: DataFrame, request: PivotRequest, time: str, window: str = "1 day", lateness: str = "1 hour", scale: int = SCALE) -> DataFrame:
    """Cells per window, in append mode: a window comes out once no record can be late for it any more.

    State is one row per open window and cell; records later than the watermark are left out."""
    fields = request.resolve(stream.schema)
    for f in request.filters:
        if f.values:
            stream = stream.where(accepts(fields[f.field], f.values))
    rows, columns, values = row_names(len(request.rows)), column_names(len(request.columns)), value_names(request.values)
    labels = [label(_quoted(fields[f].name), fields[f].dataType).alias(n) for n, f in zip(rows + columns, request.rows + request.columns)]
    measures = [measure(_quoted(fields[v.field].name), fields[v.field].dataType, v.field, v.aggregation.value, scale).alias(n) for n, v in zip(values, request.values)]
    timed = stream.withWatermark(time, lateness).select(_quoted(time).alias("_time"), *labels, *measures)
    made = [aggregate(n, v.aggregation).alias(n) for n, v in zip(values, request.values)]
    return timed.groupBy(F.window("_time", window).alias("w"), *rows, *columns).agg(*made).select(F.col("w.start").alias("window_start"), *rows, *columns, *values)
