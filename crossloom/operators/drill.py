"""From a number back to the source rows behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crossloom.operators.filters import _quoted, apply_filters, path_predicate
from crossloom.plans.errors import PivotError
from crossloom.plans.request import PivotRequest, find_fields


def drill_down(df: DataFrame, request: PivotRequest, row_path: Sequence[str] = (), column_path: Sequence[str] = (), order_by: list[str] | None = None) -> DataFrame:
    """Source rows of a cell (full paths), a subtotal (a shorter path) or a total (an empty path)."""
    fields = request.resolve(df.schema)
    for path, own, axis in ((row_path, request.rows, "row"), (column_path, request.columns, "column")):
        if len(path) > len(own):
            raise PivotError(f"the {axis} path has {len(path)} parts, the request {len(own)} {axis} fields")
    out = apply_filters(df, request.filters)
    out = out.where(path_predicate([fields[f] for f in request.rows], row_path) & path_predicate([fields[f] for f in request.columns], column_path))
    return out.orderBy(*order_by) if order_by else out


def limited(rows: DataFrame, limit: int = 1000) -> tuple[DataFrame, int, bool]:
    """(the first rows, number of all, whether some are cut off)."""
    total = rows.count()
    return rows.limit(limit), total, total > limit


def formatted(rows: DataFrame, formats: dict[str, Column] | None = None) -> dict[str, Column]:
    """What a detail view shows for each column: the given expression, else the value as text."""
    return {c: (formats or {}).get(c, F.coalesce(_quoted(c).cast("string"), F.lit(""))) for c in rows.columns}


def search(rows: DataFrame, term: str = "", filters: dict[str, Sequence[str]] | None = None, formats: dict[str, Column] | None = None) -> DataFrame:
    """Detail rows where some column's shown text has the term (case is ignored) and every filtered
    column's shown text is one of its values."""
    shown = formatted(rows, formats)
    if term.strip():
        test = F.lit(False)
        for c in shown.values():
            test = test | F.lower(c).contains(term.strip().lower())
        rows = rows.where(test)
    for name, values in (filters or {}).items():
        if values:
            rows = rows.where(shown[find_fields(rows.schema, [name])[name].name].isin(list(values)))
    return rows
