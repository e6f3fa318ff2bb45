"""Canonical labels and exact measures.

Every comparison of a dimension (headers, filters, drill paths, distinct values) is on its label: a
culture-free string in which null and the empty text are one. Measures are exact decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from crossloom.plans.errors import FieldTypeError

#: Decimals kept of float and double measures that are summed.
SCALE = 12
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def label(column: Column, kind: T.DataType) -> Column:
    """The label of a column of this type; null is the empty text.

    Whole doubles have no fraction, booleans read True and False, timestamps month first; a decimal
    keeps its column's scale. Nested, binary and interval types have no label."""
    if isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, (*INTEGRAL, T.DecimalType)):
        text = column.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        text = F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, "True").when(~column, "False")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(column, "MM/dd/yyyy HH:mm:ss")
    elif isinstance(kind, T.DateType):
        text = F.date_format(column, "MM/dd/yyyy")
    else:
        raise FieldTypeError(None, None, f"a field of type {kind.simpleString()} cannot be a dimension")
    return F.coalesce(text, F.lit(""))


def measure(column: Column, kind: T.DataType, field: str, aggregation: str, scale: int = SCALE, plain: bool = True) -> Column:
    """The column as the aggregation takes it: exact decimals; any type for counts. Least and greatest of floats and doubles
    stay as they are where they are shown plain, without further sums or differences.

    NaN and infinities raise at run time, since a cast would quietly make them null."""
    if aggregation == "count":
        return column
    if not isinstance(kind, NUMERIC):
        raise FieldTypeError(field, aggregation, f"{aggregation} of {field}: type {kind.simpleString()} is not numeric")
    if isinstance(kind, T.DecimalType):
        return column
    if isinstance(kind, INTEGRAL):
        return column.cast("decimal(20,0)")
    odd = F.isnan(column) | (F.abs(column) == float("inf"))
    fine = F.when(odd, F.raise_error(F.lit(f"{aggregation} of {field}: a value is not finite")).cast("double")).otherwise(column)
    if aggregation in ("min", "max") and plain:
        return fine.cast("double")
    return fine.cast("double").cast(f"decimal(38,{scale})") if isinstance(kind, T.DoubleType) else fine.cast("string").cast(f"decimal(38,{scale})")


def divide(a: Column, b: Column) -> Column:
    """a / b as double; null where either is null or b is zero."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def one_when_nonzero(a: Column) -> Column:
    return F.when(a != 0, F.lit(1.0))


#: Collations by culture tag; a tag that is not here is tried as it is, and none means culture-free.
COLLATIONS = {"": "UNICODE", "tr": "tr", "tr-TR": "tr", "en": "en", "en-US": "en", "de": "de", "fr": "fr", "es": "es"}


def collated(column: Column, locale: str = "", ignore_case: bool = True) -> Column:
    """The column under a culture's order. For ordering only: equality of labels stays binary."""
    name = COLLATIONS.get(locale, locale.split("-")[0])
    return F.collate(column, f"{name}_CI" if ignore_case else name)
