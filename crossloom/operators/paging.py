"""Pages of a result by ranges of row headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from crossloom.plans.engine import PivotFrames
from crossloom.plans.errors import PivotError

LEAST, MOST = 1, 1000


@dataclass
class Page:
    """A slice whose row indexes begin at 0; column and grand totals are the whole result's."""

    offset: int
    size: int
    total_rows: int
    rows: DataFrame
    cells: DataFrame
    row_totals: DataFrame
    subtotals: DataFrame | None
    column_totals: DataFrame
    grand: DataFrame

    @property
    def has_previous(self) -> bool:
        return self.offset > 0

    @property
    def has_more(self) -> bool:
        return self.offset + self.size < self.total_rows


def page(result: PivotFrames, offset: int, size: int, total_rows: int | None = None) -> Page:
    """Rows offset..offset + size - 1; an offset beyond the end is moved to it. Subtotals are those of prefixes on the page."""
    if offset < 0:
        raise PivotError("a page offset cannot be negative")
    if not LEAST <= size <= MOST:
        raise PivotError(f"a page has {LEAST} to {MOST} rows")
    total = result.rows.count() if total_rows is None else total_rows
    offset = min(offset, total)
    size = min(size, total - offset)
    cut = lambda df: df.where(F.col("row_index").between(offset, offset + size - 1)).withColumn("row_index", F.col("row_index") - offset)
    rows, subtotals = cut(result.rows), result.subtotals
    if subtotals is not None:
        depth = len(result.request.rows) - 1
        on_page = None
        for level in range(1, depth + 1):
            keys = [f"r{i}" for i in range(level)]
            own = subtotals.where(F.col("level") == level).join(F.broadcast(rows.select(*keys).distinct()), keys, "left_semi")  # at most MOST rows
            on_page = own if on_page is None else on_page.unionByName(own)
        subtotals = on_page
    return Page(offset, size, total, rows, cut(result.cells), cut(result.row_totals), subtotals, result.column_totals, result.grand)
