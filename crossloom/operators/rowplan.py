"""The rows and header cells of a cross-tab as they are displayed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossloom.functions.labels import collated
from crossloom.operators.ordering import numbered
from crossloom.plans.engine import PivotFrames

SEPARATOR = "\u001f"


def prefix_keys(paths: Iterable[Sequence[str]]) -> set[str]:
    """Paths of groups as single texts, the form in which collapsed groups are remembered."""
    return {SEPARATOR.join(p) for p in paths}


def all_groups(result: PivotFrames) -> DataFrame:
    """Keys of all groups of a result (key, level): what collapsing everything collapses."""
    depth = len(result.request.rows) - 1
    parts = [result.rows.select(F.concat_ws(SEPARATOR, *(f"r{i}" for i in range(level))).alias("key"), F.lit(level).alias("level")).distinct() for level in range(1, depth + 1)]
    return reduce(DataFrame.unionByName, parts) if parts else result.rows.select(F.lit("").alias("key"), F.lit(0).alias("level")).limit(0)


def hidden(levels: Sequence[str], collapsed: set[str], own_level: Column) -> Column:
    """Whether some ancestor of a row (a path of these columns, own_level long) is collapsed."""
    tests = [(own_level > i) & F.concat_ws(SEPARATOR, *levels[:i]).isin(sorted(k for k in collapsed if k.count(SEPARATOR) == i - 1)) for i in range(1, len(levels)) if any(k.count(SEPARATOR) == i - 1 for k in collapsed)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def row_plan(result: PivotFrames, collapsed: Iterable[Sequence[str]] = (), locale: str = "") -> DataFrame:
    """Body rows in display order: every group's subtotal row before its details, the grand total last.

    position, kind (group, detail, grand), level (labels that the row has), r0.. and the row's totals v... Groups
    stand where their first detail row stands in the result's order. Rows below a collapsed group are left out;
    the group's own row stays. Subtotals are the source's, not sums of what is shown."""
    m, names = max(1, len(result.request.rows)), list(result.keys())
    labels = [f"r{i}" for i in range(len(result.request.rows))]
    details = result.rows.join(result.row_totals, "row_index").select(F.lit("detail").alias("kind"), F.lit(m).alias("level"), *labels, *names, F.col("row_index").alias("_first"))
    parts = [details]
    if result.subtotals is not None:
        totals = result.subtotals.where("column_index IS NULL")
        for level in range(1, m):
            keys = labels[:level]
            first = result.rows.groupBy(*keys).agg(F.min("row_index").alias("_first"))
            own = totals.where(F.col("level") == level).select(*keys, *names).join(first, keys)
            parts.append(own.select(F.lit("group").alias("kind"), F.lit(level).alias("level"), *keys, *(F.lit("").alias(c) for c in labels[level:]), *names, "_first"))
    body = reduce(DataFrame.unionByName, parts)
    wanted = prefix_keys(collapsed)
    if wanted and labels:
        body = body.where(~hidden(labels, wanted, F.col("level")))
    grand = result.grand.select(F.lit("grand").alias("kind"), F.lit(0).alias("level"), *(F.lit("").alias(c) for c in labels), *names, F.lit(1 << 62).cast("long").alias("_first"))
    # Details of one group may lie apart in a value order; display keeps them under their group.
    heads = []
    for i in range(1, m):
        name = f"_head{i}"
        body = body.withColumn(name, F.when(F.col("level") >= i, F.min("_first").over(W.partitionBy(*labels[:i]))))
        grand = grand.withColumn(name, F.lit(1 << 62).cast("long"))
        heads += [F.col(name).asc_nulls_first(), *(collated(F.col(c), locale) for c in labels[i - 1 : i])]
    both = body.unionByName(grand)
    return numbered(both, [F.col("kind") == "grand", *heads, F.col("level"), F.col("_first")], "position", size=both.count()).select("position", "kind", "level", *labels, *names)


def column_groups(result: PivotFrames) -> DataFrame:
    """Header cells: level, start (column index), span, label; neighbours with equal paths share a cell."""
    n = len(result.request.columns)
    order, parts = W.partitionBy(F.lit(0)).orderBy("column_index"), []
    for level in range(n):
        path = F.concat_ws(SEPARATOR, *(f"c{i}" for i in range(level + 1)))
        marked = result.columns.select("column_index", path.alias("_path"), F.col(f"c{level}").alias("label"))
        new = F.coalesce(F.col("_path") != F.lag("_path").over(order), F.lit(True)).cast("int")
        runs = marked.withColumn("_run", F.sum(new).over(order)) if level < n - 1 else marked.withColumn("_run", F.col("column_index"))
        parts.append(runs.groupBy("_run").agg(F.min("column_index").alias("start"), F.count(F.lit(1)).alias("span"), F.first("label").alias("label")).select(F.lit(level).alias("level"), "start", "span", "label"))
    return reduce(DataFrame.unionByName, parts)


def detail_view(rows: DataFrame, captions: dict[str, str]) -> DataFrame:
    """Detail rows with the declared fields under their captions (names match in any case); without any, all fields."""
    known = {c.lower(): c for c in rows.columns}
    picked = [(known[k.lower()], v) for k, v in captions.items() if k.lower() in known]
    return rows.select(*(F.col(f"`{c}`").alias(v) for c, v in picked)) if picked else rows


def detail_title(row_path: Sequence[str], column_path: Sequence[str], measure: str, blank: str = "-") -> str:
    """What a detail view is headed: the paths and the measure."""
    return " / ".join([*(p or blank for p in (*row_path, *column_path)), measure])
