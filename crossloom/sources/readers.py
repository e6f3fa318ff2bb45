"""Sources of records: Parquet, JSON arrays, CSV texts and files, rows in memory, and providers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from crossloom.operators.filters import _quoted
from crossloom.plans.errors import PivotError

#: A provider makes a source when asked, with a hint of how many rows are wanted (or None).
Provider = Callable[[SparkSession, int | None], DataFrame]
NUMBER = "decimal(38,12)"


def flat(df: DataFrame) -> DataFrame:
    """df, if all its fields are scalars."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise PivotError(f"records must be flat; nested: {', '.join(nested)}")
    return df


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_files(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files that each hold one array of flat objects; a missing key is null, numbers are decimals first."""
    reader = spark.read.option("multiLine", True).option("prefersDecimal", True).option("mode", "FAILFAST")
    return flat((reader.schema(schema) if schema else reader).json(path))


def json_text(spark: SparkSession, text: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A request's own records: an array of flat objects. Names that differ in case only are an error."""
    rows = json.loads(text, parse_float=Decimal, object_pairs_hook=_pairs)
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise PivotError("records must be an array of objects")
    if any(isinstance(v, (dict, list)) for r in rows for v in r.values()):
        raise PivotError("records must be flat")
    return records(spark, rows, schema)


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    names = [k.lower() for k, _ in pairs]
    if len(set(names)) < len(names):
        raise PivotError("an object repeats a name")
    return dict(pairs)


def records(spark: SparkSession, rows: Iterable[Mapping[str, object]], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows in memory; without a schema their fields are all keys that occur, and a missing key is null.

    A field with numbers only is a decimal if they are all whole or decimal, else a double; mixed kinds are texts."""
    rows = [dict(r) for r in rows]
    if schema is not None:
        return flat(spark.createDataFrame([tuple(r.get(n) for n in _names(schema)) for r in rows], schema))
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        raise PivotError("records without fields need a schema")
    kinds = {n: {type(r[n]) for r in rows if r.get(n) is not None} for n in names}
    types, cast = [], {}
    for n in names:
        if kinds[n] <= {bool}:
            types.append(T.StructField(n, T.BooleanType()))
        elif kinds[n] <= {int, Decimal}:
            own = [Decimal(r[n]) for r in rows if r.get(n) is not None]
            whole, decimals = max(max(v.adjusted() + 1, 1) for v in own), max(max(-v.as_tuple().exponent, 0) for v in own)
            if whole <= 18 and decimals == 0:
                types.append(T.StructField(n, T.LongType()))
                cast[n] = int
            else:
                if whole > 38:
                    raise PivotError(f"{n}: a number has more than 38 digits")
                types.append(T.StructField(n, T.DecimalType(38, min(decimals, 38 - whole))))
                cast[n] = Decimal
        elif kinds[n] <= {int, float, Decimal}:
            types.append(T.StructField(n, T.DoubleType()))
            cast[n] = float
        else:
            types.append(T.StructField(n, T.StringType()))
            cast[n] = lambda v: v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list, bool)) else str(v)
    data = [tuple(None if r.get(n) is None else cast.get(n, lambda v: v)(r[n]) for n in names) for r in rows]
    return spark.createDataFrame(data, T.StructType(types))


def _names(schema: T.StructType | str) -> list[str]:
    return (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fieldNames()


def csv_files(spark: SparkSession, path: str, numbers: Iterable[str] = ()) -> DataFrame:
    """Files with a header row and doubled quotes; blanks are null. The named columns become decimals:
    group commas and outer blanks are dropped, and what then is no number is null."""
    df = spark.read.options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False).csv(path)
    return typed(df, numbers)


def csv_text(spark: SparkSession, text: str, numbers: Iterable[str] | None = None) -> DataFrame:
    """A request's own CSV. Without names of number columns, those are numbers whose cells all are (or are blank)."""
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text, newline="")))
    if not rows:
        raise PivotError("a CSV needs a header row")
    names, body = rows[0], [r or [""] for r in rows[1:]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)])
    keep = {n: i for i, n in enumerate(names)}  # a repeated name keeps its last cell
    data = [tuple((r[keep[n]] if keep[n] < len(r) and r[keep[n]].strip() else None) for n in schema.fieldNames()) for r in body]
    if numbers is not None:
        return typed(spark.createDataFrame(data, schema), numbers)
    kinds = {n: _decimals([r[i] for r in data]) for i, n in enumerate(schema.fieldNames())}
    # Numbers keep as many decimals as their cells have, up to 38 digits in all.
    long = {n: any(len(c.strip().lstrip("+-").replace(",", "").partition(".")[0]) > 18 for c in (r[i] for r in data) if c is not None) for i, n in enumerate(schema.fieldNames())}
    return typed(spark.createDataFrame(data, schema), {n: "bigint" if d == 0 and not long[n] else f"decimal(38,{d})" for n, d in kinds.items() if d is not None})


def _decimals(cells: list[str | None]) -> int | None:
    """The most decimals among a column's cells; None if some cell is no number or all are blank."""
    full = [c.strip().replace(",", "") for c in cells if c is not None]
    if not full or not all(_is_number(c) for c in full):
        return None
    decimals, whole = max(len(c.partition(".")[2]) for c in full), max(len(c.partition(".")[0].lstrip("+-")) for c in full)
    return max(0, min(decimals, 38 - whole))


def _is_number(cell: str) -> bool:
    body = cell.strip().replace(",", "").lstrip("+-")
    return body.replace(".", "", 1).isdigit() and body.isascii()


def typed(df: DataFrame, numbers: Iterable[str]) -> DataFrame:
    wanted = {n.lower(): numbers[n] if isinstance(numbers, dict) else NUMBER for n in numbers}
    out = []
    for f in df.schema.fields:
        c = F.when(F.trim(_quoted(f.name)) != "", _quoted(f.name))
        out.append((F.trim(F.regexp_replace(c, ",", "")).try_cast(wanted[f.name.lower()]) if f.name.lower() in wanted else c).alias(f.name))
    return df.select(*out)


def hinted(provider: Provider) -> Provider:
    """A provider whose source is cut to the hint, for providers that do not look at it themselves."""

    def run(spark: SparkSession, hint: int | None) -> DataFrame:
        df = provider(spark, hint)
        return df if hint is None else df.limit(hint)

    return run
