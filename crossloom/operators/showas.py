"""Secondary calculations along the column axis: ratios, differences from the previous column, running totals.

The axis is one series from left to right; an outer column level does not begin it anew. "Previous" is
the nearest column to the left with a value; a running total is carried into empty cells to the right of
its first value, which is the only case that makes cells dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossloom.functions.labels import divide, one_when_nonzero
from crossloom.plans.request import ShowAs, Value


def _previous(column: str, window) -> Column:
    return F.last(column, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))


def _running(column: str, window) -> Column:
    return F.sum(column).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))


def show_cells(cells: DataFrame, keys: list[str], names: list[str], values: tuple[Value, ...], columns: DataFrame, row_totals: DataFrame, column_totals: DataFrame, grand: DataFrame) -> DataFrame:
    """Cells (keys, column_index, names) as their values are shown.

    keys are row labels, of all levels or of a subtotal's prefix; totals are raw."""
    modes = {v.show_as for v in values}
    if ShowAs.RUNNING_TOTAL in modes:
        grid = cells.select(*keys).distinct().crossJoin(columns.select("column_index"))
        cells = grid.join(cells.withColumn("_there", F.lit(True)), [*keys, "column_index"], "left")
    if ShowAs.PERCENT_OF_ROW in modes:
        cells = cells.join(row_totals.select(*keys, *(F.col(n).alias(f"_row_{n}") for n in names)), keys, "left")
    if ShowAs.PERCENT_OF_COLUMN in modes:
        cells = cells.join(column_totals.select("column_index", *(F.col(n).alias(f"_column_{n}") for n in names)), "column_index", "left")
    if ShowAs.PERCENT_OF_GRAND in modes:
        cells = cells.crossJoin(F.broadcast(grand.select(*(F.col(n).alias(f"_grand_{n}") for n in names))))  # one row
    along = W.partitionBy(*keys).orderBy("column_index")
    out = {}
    for n, v in zip(names, values):
        raw = F.col(n)
        out[n] = {
            ShowAs.NORMAL: lambda: raw,
            ShowAs.PERCENT_OF_ROW: lambda: divide(raw, F.col(f"_row_{n}")),
            ShowAs.PERCENT_OF_COLUMN: lambda: divide(raw, F.col(f"_column_{n}")),
            ShowAs.PERCENT_OF_GRAND: lambda: divide(raw, F.col(f"_grand_{n}")),
            ShowAs.DIFFERENCE: lambda: raw - _previous(n, along),
            ShowAs.PERCENT_DIFFERENCE: lambda: divide(raw - _previous(n, along), _previous(n, along)),
            ShowAs.RUNNING_TOTAL: lambda: _running(n, along),
        }[v.show_as]()
    extra = [F.col("_there")] if ShowAs.RUNNING_TOTAL in modes else []
    shown = cells.select(*keys, "column_index", *(c.alias(n) for n, c in out.items()), *extra)
    if extra:
        carried = [F.col(n).isNotNull() for n, v in zip(names, values) if v.show_as is ShowAs.RUNNING_TOTAL]
        shown = shown.where(F.col("_there") | F.greatest(*carried) if len(carried) > 1 else F.coalesce(F.col("_there"), F.lit(False)) | carried[0]).drop("_there")
    return shown


def show_row_totals(totals: DataFrame, names: list[str], values: tuple[Value, ...], grand: DataFrame) -> DataFrame:
    """Totals of rows (or of subtotals) as shown: shares of the row are one, other shares are of the grand total."""
    out, modes = {}, {v.show_as for v in values}
    if modes & {ShowAs.PERCENT_OF_COLUMN, ShowAs.PERCENT_OF_GRAND}:
        totals = totals.crossJoin(F.broadcast(grand.select(*(F.col(n).alias(f"_grand_{n}") for n in names))))  # one row
    for n, v in zip(names, values):
        if v.show_as is ShowAs.PERCENT_OF_ROW:
            out[n] = one_when_nonzero(F.col(n))
        elif v.show_as in (ShowAs.PERCENT_OF_COLUMN, ShowAs.PERCENT_OF_GRAND):
            out[n] = divide(F.col(n), F.col(f"_grand_{n}"))
        elif v.show_as in (ShowAs.DIFFERENCE, ShowAs.PERCENT_DIFFERENCE):
            out[n] = F.lit(None).cast("double")
    return totals.withColumns(out).drop(*(f"_grand_{n}" for n in names)) if out else totals


def show_column_totals(totals: DataFrame, names: list[str], values: tuple[Value, ...], grand: DataFrame) -> DataFrame:
    """Totals of all columns (column_index, names; null where a column has no rows) as shown."""
    along, out = W.partitionBy(F.lit(0)).orderBy("column_index"), {}
    totals = totals.crossJoin(F.broadcast(grand.select(*(F.col(n).alias(f"_grand_{n}") for n in names))))  # one row
    for n, v in zip(names, values):
        if v.show_as in (ShowAs.PERCENT_OF_ROW, ShowAs.PERCENT_OF_GRAND):
            out[n] = divide(F.col(n), F.col(f"_grand_{n}"))
        elif v.show_as is ShowAs.PERCENT_OF_COLUMN:
            out[n] = one_when_nonzero(F.col(n))
        elif v.show_as is ShowAs.DIFFERENCE:
            out[n] = F.col(n) - _previous(n, along)
        elif v.show_as is ShowAs.PERCENT_DIFFERENCE:
            out[n] = divide(F.col(n) - _previous(n, along), _previous(n, along))
        elif v.show_as is ShowAs.RUNNING_TOTAL:
            out[n] = _running(n, along)
    return totals.withColumns(out).drop(*(f"_grand_{n}" for n in names))


def show_grand(grand: DataFrame, names: list[str], values: tuple[Value, ...]) -> DataFrame:
    out = {}
    for n, v in zip(names, values):
        if v.show_as in (ShowAs.PERCENT_OF_ROW, ShowAs.PERCENT_OF_COLUMN, ShowAs.PERCENT_OF_GRAND):
            out[n] = one_when_nonzero(F.col(n))
        elif v.show_as in (ShowAs.DIFFERENCE, ShowAs.PERCENT_DIFFERENCE):
            out[n] = F.lit(None).cast("double")
    return grand.withColumns(out) if out else grand
