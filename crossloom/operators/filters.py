"""Filters and drill predicates over labels, rewritten so that scans can push them down."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from crossloom.functions.labels import INTEGRAL, label
from crossloom.plans.request import Filter, find_fields


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def accepts(field: T.StructField, values: Sequence[str | None]) -> Column:
    """Whether the field's label is one of values. A null among them matches nothing.

    For texts and integers the test is on the bare column, which Parquet scans can take; other types
    compare labels."""
    column, wanted = _quoted(field.name), list(dict.fromkeys(v for v in values if v is not None))
    blank = "" in wanted
    if isinstance(field.dataType, T.StringType):
        test = column.isin(wanted) if wanted else F.lit(False)
    elif isinstance(field.dataType, INTEGRAL):
        numbers = []
        for v in wanted:
            try:
                numbers += [int(v)] if str(int(v)) == v and abs(int(v)) < 1 << 63 else []
            except ValueError:
                continue
        test = column.isin(numbers) if numbers else F.lit(False)
    else:
        return label(column, field.dataType).isin(wanted) if wanted else F.lit(False)
    return test | column.isNull() if blank else test


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """AND over the filters, OR within one; a filter without values restricts nothing, but its field must exist."""
    fields = find_fields(df.schema, [f.field for f in filters])
    for f in filters:
        if f.values:
            test = accepts(fields[f.field], f.values)
            df = df.where(test)
    return df


def path_predicate(fields: Sequence[T.StructField], path: Sequence[str | None]) -> Column:
    """Rows whose leading labels are the path; a shorter path takes in everything below it."""
    tests = [accepts(f, (p,)) for f, p in zip(fields, path)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
