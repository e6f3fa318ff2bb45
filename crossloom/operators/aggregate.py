"""All aggregates of a request from one pass: rows are aggregated to cells, and all totals come from cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from crossloom.functions.labels import SCALE, divide, label, measure
from crossloom.operators.filters import _quoted, apply_filters
from crossloom.plans.request import Aggregation, PivotRequest, ShowAs, Value


def row_names(n: int) -> list[str]:
    return [f"r{i}" for i in range(n)]


def column_names(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def value_names(values: tuple[Value, ...]) -> list[str]:
    return [f"v{i}" for i in range(len(values))]


def aggregate(column: str, kind: Aggregation) -> Column:
    """One aggregate; null inputs are passed over, averages are exact sums over counts."""
    if kind is Aggregation.COUNT:
        return F.count(column)
    if kind is Aggregation.AVERAGE:
        return divide(F.sum(column), F.count(column))
    return {Aggregation.SUM: F.sum, Aggregation.MIN: F.min, Aggregation.MAX: F.max}[kind](column)


def _parts(name: str, kind: Aggregation) -> list[Column]:
    """What a cell keeps of a measure, so that totals can be made from cells: a sum and a count for averages."""
    if kind is Aggregation.AVERAGE:
        return [F.sum(name).alias(name), F.count(name).alias(f"{name}_n")]
    return [aggregate(name, kind).alias(name)]


def _finished(name: str, kind: Aggregation) -> Column:
    """A cell's measure from its parts."""
    return divide(F.col(name), F.col(f"{name}_n")).alias(name) if kind is Aggregation.AVERAGE else F.col(name)


def _total(name: str, kind: Aggregation, part: T.DataType) -> Column:
    """A total's measure from cells' parts; sums keep the type that they have over rows."""
    if kind is Aggregation.COUNT:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)
    if kind is Aggregation.AVERAGE:
        return divide(F.sum(name), F.sum(f"{name}_n")).alias(name)
    return (F.sum(name).cast(part) if kind is Aggregation.SUM else aggregate(name, kind)).alias(name)


@dataclass
class Aggregates:
    """Slices of aggregated frames: labels r0.., c0.., measures v0.., and the first place `ord`.

    cells: the finest groups, with the parts of their measures; frame: the totals of all coarser groupings."""

    cells: DataFrame
    frame: DataFrame
    grand: DataFrame
    kinds: tuple[Aggregation, ...]
    rows: list[str]
    columns: list[str]
    values: list[str]

    def slice(self, rows: int, columns: bool) -> DataFrame:
        """Groups by the first `rows` row labels, and by all column labels or none."""
        keys = self.rows[:rows] + (self.columns if columns else [])
        everything = self.rows + self.columns
        if len(keys) == len(everything):
            return self.cells.select(*keys, *map(_finished, self.values, self.kinds), "ord")
        mark = sum(1 << (len(everything) - 1 - i) for i, c in enumerate(everything) if c not in keys)
        return self.frame.where(F.col("_set") == mark).select(*keys, *self.values, "ord")


def aggregate_all(df: DataFrame, request: PivotRequest, order_by: list[str] | None = None, scale: int = SCALE, persist: bool = False) -> Aggregates:
    """Cells, totals on both axes, subtotals of every proper row prefix, and the grand total.

    A request without row (or column) fields has one row (column) with an empty path. order_by names the
    columns whose order is the source's order; without it, the order of the scan, as far as that is stable.
    The grand total is there even if no row is. Source rows are read once, and aggregated to cells
    before the one shuffle; the grouping sets of the totals run over cells. persist keeps cells and totals."""
    fields = request.resolve(df.schema)
    base = apply_filters(df, request.filters)
    rows, columns, values = row_names(max(1, len(request.rows))), column_names(max(1, len(request.columns))), value_names(request.values)
    labelled = lambda names, own: [label(_quoted(fields[f].name), fields[f].dataType).alias(n) for n, f in zip(names, own)] or [F.lit("").alias(names[0])]
    measures = [measure(_quoted(fields[v.field].name), fields[v.field].dataType, v.field, v.aggregation.value, scale, v.show_as is ShowAs.NORMAL).alias(n) for n, v in zip(values, request.values)]
    order = [_quoted(c) for c in order_by] if order_by else [F.monotonically_increasing_id()]
    base = base.select(*labelled(rows, request.rows), *labelled(columns, request.columns), *measures, (order[0] if len(order) == 1 else F.struct(*order)).alias("ord"))
    kinds = tuple(v.aggregation for v in request.values)
    cells = base.groupBy(*rows, *columns).agg(*(p for n, k in zip(values, kinds) for p in _parts(n, k)), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("_rows"))
    cells = cells.persist() if persist else cells
    made = [_total(n, k, cells.schema[n].dataType) for n, k in zip(values, kinds)]
    sets = [rows, columns, *(s for k in range(1, len(rows)) for s in (rows[:k] + columns, rows[:k]))]
    frame = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in rows + columns]).agg(*made, F.min("ord").alias("ord"), F.grouping_id().alias("_set"))
    frame = frame.persist() if persist else frame
    grand = cells.agg(*made, F.coalesce(F.sum("_rows"), F.lit(0)).alias("source_rows"))
    return Aggregates(cells, frame, grand, kinds, rows, columns, values)


def distinct_values(df: DataFrame, field: str, locale: str = "", limit: int | None = None) -> DataFrame:
    """(value, position) of a field's labels for a filter list: filters are not applied, the blank comes first.

    Numbers, dates and the like stand in their own order, texts in the culture's, case told apart. With a
    limit, the first so many and the number of all as `total`."""
    from crossloom.functions.labels import collated
    from crossloom.operators.ordering import numbered
    from crossloom.plans.request import find_fields

    own = find_fields(df.schema, [field])[field]
    column = _quoted(own.name)
    text = isinstance(own.dataType, T.StringType)
    found = df.groupBy(label(column, own.dataType).alias("value")).agg(F.min(column).alias("_raw"))
    key = collated(F.col("value"), locale, ignore_case=False) if text else F.col("_raw")
    total = found.count()
    out = numbered(found, [F.col("value") != "", key.asc_nulls_first(), F.col("value")], "position", size=total).select("value", "position")
    if limit is not None:
        out = out.where(F.col("position") < limit).withColumn("total", F.lit(total).cast("long"))
    return out
