"""The declarative query: row fields, column fields, measures, filters and a row order."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import types as T

from .errors import FieldNotFoundError, PivotError


class Aggregation(str, Enum):
    SUM, COUNT, AVERAGE, MIN, MAX = "sum", "count", "average", "min", "max"


class ShowAs(str, Enum):
    NORMAL = "normal"
    PERCENT_OF_ROW = "percent_of_row_total"
    PERCENT_OF_COLUMN = "percent_of_column_total"
    PERCENT_OF_GRAND = "percent_of_grand_total"
    DIFFERENCE = "difference_from_previous"
    PERCENT_DIFFERENCE = "percent_difference_from_previous"
    RUNNING_TOTAL = "running_total"

    @property
    def is_ratio(self) -> bool:
        return self in (ShowAs.PERCENT_OF_ROW, ShowAs.PERCENT_OF_COLUMN, ShowAs.PERCENT_OF_GRAND, ShowAs.PERCENT_DIFFERENCE)


class SortBy(str, Enum):
    LABELS, ROW_LABEL, ROW_TOTAL, COLUMN_VALUE = "labels", "row_label", "row_total_value", "column_value"


@dataclass(frozen=True)
class Value:
    field: str
    aggregation: Aggregation = Aggregation.SUM
    show_as: ShowAs = ShowAs.NORMAL

    @property
    def key(self) -> str:
        """Identity of the measure; how it is shown is no part of it."""
        return f"{self.field}_{self.aggregation.value}"


@dataclass(frozen=True)
class Filter:
    """Rows whose label is one of values; no values: no restriction. An empty text selects blanks."""

    field: str
    values: tuple[str | None, ...] = ()


@dataclass(frozen=True)
class RowSort:
    by: SortBy = SortBy.LABELS
    descending: bool = False
    field: str | None = None
    value_key: str | None = None
    column_path: tuple[str, ...] = ()


@dataclass(frozen=True)
class PivotRequest:
    rows: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    values: tuple[Value, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: RowSort = field(default_factory=RowSort)

    def resolve(self, schema: T.StructType) -> dict[str, T.StructField]:
        """Checks the request against a source; the source's field for every name used (case is ignored)."""
        if not self.values:
            raise PivotError("a request needs at least one value")
        keys = [v.key for v in self.values]
        if len(set(keys)) < len(keys):
            raise PivotError(f"values repeat: {', '.join(sorted(k for k in set(keys) if keys.count(k) > 1))}")
        return find_fields(schema, [*self.rows, *self.columns, *(v.field for v in self.values), *(f.field for f in self.filters)])

    def identity(self, *more: object) -> str:
        """SHA-256 of the request and whatever else tells two results apart (the culture among it)."""
        return hashlib.sha256(json.dumps([asdict(self), *map(str, more)], sort_keys=True).encode()).hexdigest()


def find_fields(schema: T.StructType, names: list[str]) -> dict[str, T.StructField]:
    known: dict[str, T.StructField] = {}
    for f in schema.fields:
        known.setdefault(f.name.lower(), f)
    out = {}
    for name in names:
        if not name or not name.strip():
            raise PivotError("a field name is blank")
        if name.lower() not in known:
            raise FieldNotFoundError(name)
        out[name] = known[name.lower()]
    return out
