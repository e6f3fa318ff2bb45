"""From a request to result frames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crossloom.functions.labels import SCALE, collated
from crossloom.operators.aggregate import Aggregates, aggregate_all, column_names
from crossloom.operators.ordering import numbered
from crossloom.operators.showas import show_cells, show_column_totals, show_grand, show_row_totals

from .errors import PivotError
from .request import PivotRequest, RowSort, SortBy

#: Columns that a request with two or more column fields may spread to, and that may be broadcast.
MAX_COLUMNS = 100_000


@dataclass
class PivotFrames:
    """A result. Measures are columns v0, v1, ... in the request's order; keys() has their names.

    rows: row_index, r0..; columns: column_index, c0..; cells (only those that exist): row_index,
    column_index, v..; row_totals: row_index, v..; column_totals: column_index, v..; subtotals: level, place
    (order of first appearance in the level), r0.. of the prefix, column_index (null: the subtotal's
    total), v..; grand: v.., source_rows."""

    request: PivotRequest
    rows: DataFrame
    columns: DataFrame
    cells: DataFrame
    row_totals: DataFrame
    column_totals: DataFrame
    subtotals: DataFrame | None
    grand: DataFrame
    width: int = 0
    held: list[DataFrame] = field(default_factory=list)

    def keys(self) -> dict[str, str]:
        return {f"v{i}": v.key for i, v in enumerate(self.request.values)}

    def labelled_cells(self) -> DataFrame:
        """Cells with both label paths."""
        return self.cells.join(self.rows, "row_index").join(F.broadcast(self.columns) if self.width <= MAX_COLUMNS else self.columns, "column_index")

    def metadata(self) -> DataFrame:
        """One row: source rows after filtering, row headers, column headers, cells."""
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        return self.grand.select("source_rows").crossJoin(one(self.rows, "row_headers")).crossJoin(one(self.columns, "column_headers")).crossJoin(one(self.cells, "cell_count"))

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()


def _column_axis(agg: Aggregates, max_columns: int) -> tuple[DataFrame, int]:
    """(column_index and labels, how many): those seen, by first appearance; with two or more fields the full grid of
    the levels' labels, each level by first appearance, the outer level slowest."""
    seen = agg.slice(0, True)
    if len(agg.columns) == 1:
        size = seen.count()
        return numbered(seen.select(*agg.columns, "ord"), [F.col("ord"), F.col("c0")], "column_index", size=size).drop("ord"), size
    levels = [seen.groupBy(c).agg(F.min("ord").alias("ord")) for c in agg.columns]
    sizes = [df.count() for df in levels]
    size = reduce(lambda a, b: a * b, sizes)
    if size > max_columns:
        raise PivotError(f"the column fields spread to {size} columns; at most {max_columns} are allowed")
    levels = [numbered(df, [F.col("ord"), F.col(c)], f"_{c}", size=n).drop("ord") for df, c, n in zip(levels, agg.columns, sizes)]
    grid = reduce(lambda a, b: a.crossJoin(b), levels)  # checked above
    return numbered(grid, [F.col(f"_{c}") for c in agg.columns], "column_index", size=size).drop(*(f"_{c}" for c in agg.columns)), size


def _row_order(request: PivotRequest, agg: Aggregates, totals: DataFrame, cells: DataFrame, columns: DataFrame, locale: str) -> tuple[DataFrame, list]:
    """Row labels with what the order needs, and the order."""
    sort, rows = request.sort, totals.select(*agg.rows, "ord", *agg.values)
    first = [F.col("ord"), *(F.col(c) for c in agg.rows)]
    if sort.by is SortBy.LABELS:
        return rows, [*(collated(F.col(c), locale).asc() for c in agg.rows), *first]
    if sort.by is SortBy.ROW_LABEL:
        names = [f.lower() for f in request.rows]
        key = collated(F.col(agg.rows[names.index((sort.field or "").lower()) if (sort.field or "").lower() in names else 0]), locale)
        return rows, [key.desc(), *(c.desc() for c in first)] if sort.descending else [key.asc(), *first]
    if not sort.value_key:
        return rows, first
    keys = {v.key: n for v, n in zip(request.values, agg.values)}
    value = F.lit(None).cast("double")
    if sort.value_key in keys:
        value = F.col(keys[sort.value_key])
        if sort.by is SortBy.COLUMN_VALUE:
            value = F.lit(None).cast("double")
            if len(sort.column_path) == len(request.columns):
                at = [F.col(c) == F.lit(p) for c, p in zip(agg.columns, sort.column_path)]
                picked = columns.where(reduce(lambda a, b: a & b, at, F.lit(True))).select("column_index")
                own = cells.join(F.broadcast(picked), "column_index").select(*agg.rows, F.col(keys[sort.value_key]).alias("_sort"))
                rows, value = rows.join(own, agg.rows, "left"), F.col("_sort")
    path = collated(F.concat_ws("\u001f", *agg.rows), locale)
    return rows, [value.desc_nulls_last() if sort.descending else value.asc_nulls_last(), path.asc(), *first]


def pivot(df: DataFrame, request: PivotRequest, *, order_by: list[str] | None = None, locale: str = "", scale: int = SCALE, max_columns: int = MAX_COLUMNS, persist: bool = True) -> PivotFrames:
    """Runs a request.

    One aggregation of the source to cells feeds everything else; cells and their totals are kept in memory or on the
    executors' disks until release(), since axes, totals and windows all read them. The number of columns is checked
    before a grid is spread; rows are numbered in one window or, if many, by a distributed sort."""
    agg = aggregate_all(df, request, order_by, scale, persist)
    held = [agg.cells, agg.frame] if persist else []
    m, names, values = len(agg.rows), agg.values, request.values
    columns, width = _column_axis(agg, max_columns)
    raw_rows, raw_columns, grand = agg.slice(m, False), agg.slice(0, True).drop("ord"), agg.grand
    on_axis = F.broadcast(columns) if width <= MAX_COLUMNS else columns
    raw_column_totals = columns.join(raw_columns, agg.columns, "left").select("column_index", *names)

    def shown(level: int) -> tuple[DataFrame, DataFrame]:
        keys, totals = agg.rows[:level], agg.slice(level, False)
        cells = agg.slice(level, True).join(on_axis, agg.columns).select(*keys, "column_index", *names)
        return show_cells(cells, keys, names, values, columns, totals, raw_column_totals, grand), show_row_totals(totals, names, values, grand)

    cells, totals = shown(m)
    order_rows, order = _row_order(request, agg, totals, cells, columns, locale)
    rows = numbered(order_rows, order, "row_index", size=raw_rows.count()).select("row_index", *agg.rows)
    subtotals = None
    for level in range(1, m):
        own_cells, own_totals = shown(level)
        keys = agg.rows[:level]
        places = numbered(own_totals.select(*keys, "ord"), [F.col("ord"), *(F.col(k) for k in keys)], "place", size=agg.slice(level, False).count()).drop("ord")
        both = own_cells.unionByName(own_totals.drop("ord").withColumn("column_index", F.lit(None).cast("long"))).join(places, keys)
        part = both.select(F.lit(level).alias("level"), "place", *keys, *(F.lit("").alias(c) for c in agg.rows[level : m - 1]), "column_index", *names)
        subtotals = part if subtotals is None else subtotals.unionByName(part)
    blank = [] if request.columns else column_names(1)
    return PivotFrames(
        request, rows.drop(*([] if request.rows else ["r0"])), columns.select("column_index", *(c for c in agg.columns if c not in blank)),
        cells.join(rows, agg.rows).select("row_index", "column_index", *names), totals.join(rows, agg.rows).select("row_index", *names),
        show_column_totals(raw_column_totals, names, values, grand), subtotals, show_grand(grand, names, values), width, held,
    )


def sorted_by(request: PivotRequest, sort: RowSort) -> PivotRequest:
    return PivotRequest(request.rows, request.columns, request.values, request.filters, sort)
