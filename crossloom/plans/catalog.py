"""The registered pivot queries, and SQL that gives the same rows.

Sums are exact decimals that become doubles at the end; rows and columns have their indexes as columns, so
that order is part of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossloom.functions.display import Rule, highlight
from crossloom.operators.aggregate import distinct_values
from crossloom.operators.drill import drill_down, search
from crossloom.operators.paging import page
from crossloom.operators.rowplan import column_groups, row_plan
from crossloom.plans.engine import PivotFrames, pivot
from crossloom.plans.request import Aggregation as A, Filter, PivotRequest, RowSort, ShowAs as S, SortBy, Value
from crossloom.sources import readers
from crossloom.sources.sinks import wide

PRICE, QUANTITY = Value("l_extendedprice"), Value("l_quantity")
FLAG_STATUS = PivotRequest(("l_returnflag",), ("l_linestatus",), (PRICE,))
STATUS_PRIORITY = PivotRequest(("o_orderstatus", "o_orderpriority"), (), (Value("o_totalprice"),))
CUSTOMER_PRIORITY = PivotRequest(("o_custkey",), ("o_orderpriority",), (Value("o_totalprice"),))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(df: DataFrame, frames: PivotFrames, **labels: str) -> DataFrame:
    """df with labels and measures under their own names; measures as doubles (counts as longs)."""
    counts = {f"v{i}" for i, v in enumerate(frames.request.values) if v.aggregation is A.COUNT and v.show_as is S.NORMAL}
    out = []
    for c in df.columns:
        if c in frames.keys():
            out.append(F.col(c).cast("long" if c in counts else "double").alias(frames.keys()[c]))
        else:
            out.append(F.col(c).alias(labels.get(c, c)))
    return df.select(*out)


def _cells(spark, sf_dir, request, name="lineitem", labels=None, order_by=None, index=False) -> DataFrame:
    r = pivot(_table(spark, sf_dir, name), request, order_by=order_by)
    out = r.labelled_cells()
    return _named(out if index else out.drop("row_index", "column_index"), r, **(labels or {"r0": "row_label", "c0": "column_label"}))


def pivot_sum_cells(spark, sf_dir):
    return _cells(spark, sf_dir, FLAG_STATUS)


def pivot_all_aggs(spark, sf_dir):
    return _cells(spark, sf_dir, PivotRequest(("l_returnflag",), ("l_linestatus",), tuple(Value("l_quantity", a) for a in A)))


def pivot_multi_values(spark, sf_dir):
    return _cells(spark, sf_dir, PivotRequest(("l_returnflag",), ("l_linestatus",), (PRICE, Value("l_discount", A.AVERAGE), Value("l_tax", A.MAX))))


def pivot_row_totals(spark, sf_dir):
    r = pivot(_table(spark, sf_dir, "lineitem"), FLAG_STATUS)
    return _named(r.row_totals.join(r.rows, "row_index"), r, r0="row_label")


def pivot_column_totals(spark, sf_dir):
    r = pivot(_table(spark, sf_dir, "lineitem"), FLAG_STATUS)
    return _named(r.column_totals.join(r.columns, "column_index").drop("column_index"), r, c0="column_label")


def pivot_grand_total(spark, sf_dir):
    r = pivot(_table(spark, sf_dir, "lineitem"), FLAG_STATUS)
    return _named(r.grand, r)


def pivot_metadata(spark, sf_dir):
    return pivot(_table(spark, sf_dir, "orders"), CUSTOMER_PRIORITY, order_by=["o_orderkey"]).metadata()


def pivot_empty_grand_total(spark, sf_dir):
    request = PivotRequest(("l_returnflag",), ("l_linestatus",), (PRICE, Value("l_quantity", A.COUNT)), (Filter("l_returnflag", ("no such label",)),))
    r = pivot(_table(spark, sf_dir, "lineitem"), request)
    return _named(r.grand, r)


def pivot_subtotals(spark, sf_dir):
    request = PivotRequest(("o_orderstatus", "o_orderpriority"), (), (Value("o_totalprice"), Value("o_orderkey", A.COUNT)))
    r = pivot(_table(spark, sf_dir, "orders"), request, order_by=["o_orderkey"])
    return _named(r.subtotals.where("column_index IS NULL").drop("column_index"), r, r0="status")


def pivot_filter_in(spark, sf_dir):
    return _cells(spark, sf_dir, PivotRequest(("l_returnflag",), ("l_linestatus",), (PRICE,), (Filter("l_returnflag", ("A", "R")),)))


def pivot_filter_and(spark, sf_dir):
    return _cells(spark, sf_dir, PivotRequest(("l_returnflag",), ("l_linestatus",), (QUANTITY,), (Filter("l_returnflag", ("A", "N")), Filter("l_linestatus", ("O",)), Filter("l_discount", ("0.05", "0.06")), Filter("l_linenumber", ()))))


def pivot_filter_blank(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    r = pivot(df, PivotRequest(("flag",), ("l_linestatus",), (QUANTITY,), (Filter("flag", ("", "R", None)),)))
    return _named(r.labelled_cells().drop("row_index", "column_index"), r, r0="row_label", c0="column_label")


def pivot_label_double(spark, sf_dir):
    return _cells(spark, sf_dir, PivotRequest(("l_discount",), ("l_quantity",), (Value("l_extendedprice", A.COUNT),)))


def pivot_label_time(spark, sf_dir):
    return _cells(spark, sf_dir, PivotRequest(("l_shipdate",), (), (QUANTITY,)), labels={"r0": "row_label"})


def pivot_column_order(spark, sf_dir):
    return pivot(_table(spark, sf_dir, "orders"), CUSTOMER_PRIORITY, order_by=["o_orderkey"]).columns.withColumnRenamed("c0", "column_label")


def pivot_column_grid(spark, sf_dir):
    r = pivot(_table(spark, sf_dir, "part"), PivotRequest((), ("p_brand", "p_size"), (Value("p_retailprice"),)), order_by=["p_partkey"])
    return _named(r.columns.join(r.column_totals, "column_index"), r, c0="brand", c1="size")


def _rows(spark, sf_dir, request, name="orders") -> DataFrame:
    return pivot(_table(spark, sf_dir, name), request, order_by=["o_orderkey"]).rows


def pivot_rows_default_sort(spark, sf_dir):
    return _rows(spark, sf_dir, STATUS_PRIORITY)


def pivot_rows_label_desc(spark, sf_dir):
    return _rows(spark, sf_dir, PivotRequest(STATUS_PRIORITY.rows, (), STATUS_PRIORITY.values, (), RowSort(SortBy.ROW_LABEL, True, "o_orderpriority")))


def pivot_rows_total_desc(spark, sf_dir):
    return _rows(spark, sf_dir, PivotRequest(("o_custkey",), (), CUSTOMER_PRIORITY.values, (), RowSort(SortBy.ROW_TOTAL, True, value_key="o_totalprice_sum")))


def pivot_rows_column_value(spark, sf_dir):
    return _rows(spark, sf_dir, PivotRequest(CUSTOMER_PRIORITY.rows, CUSTOMER_PRIORITY.columns, CUSTOMER_PRIORITY.values, (), RowSort(SortBy.COLUMN_VALUE, False, value_key="o_totalprice_sum", column_path=("2-HIGH",))))


def _share(show: S):
    def run(spark, sf_dir):
        r = pivot(_table(spark, sf_dir, "lineitem"), PivotRequest(("l_returnflag",), ("l_linestatus",), (Value("l_extendedprice", show_as=show),)))
        cells = r.labelled_cells().select("r0", "c0", "v0")
        rows = r.row_totals.join(r.rows, "row_index").select("r0", F.lit(None).cast("string").alias("c0"), "v0")
        columns = r.column_totals.join(r.columns, "column_index").select(F.lit(None).cast("string").alias("r0"), "c0", "v0")
        grand = r.grand.select(F.lit(None).cast("string").alias("r0"), F.lit(None).cast("string").alias("c0"), "v0")
        return cells.union(rows).union(columns).union(grand).select(F.col("r0").alias("row_label"), F.col("c0").alias("column_label"), F.col("v0").cast("double").alias("share"))

    return run


def _daily(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def _series(show: S, aggregation: A = A.SUM):
    def run(spark, sf_dir):
        r = pivot(_daily(spark, sf_dir), PivotRequest(("user_id",), ("day",), (Value("value", aggregation, show),)), order_by=["event_id"])
        cells = r.labelled_cells().select("r0", "c0", "v0")
        columns = r.column_totals.join(r.columns, "column_index").select(F.lit(None).cast("string").alias("r0"), "c0", "v0")
        return cells.union(columns).select(F.col("r0").alias("user_label"), F.col("c0").alias("day"), F.col("v0").cast("double").alias("shown"))

    return run


def showas_avg_pct_row(spark, sf_dir):
    return _cells(spark, sf_dir, PivotRequest(("l_returnflag",), ("l_linestatus",), (Value("l_quantity", A.AVERAGE, S.PERCENT_OF_ROW),)))


def showas_subtotals(spark, sf_dir):
    request = PivotRequest(("o_orderstatus", "o_orderpriority"), ("year",), (Value("o_totalprice", show_as=S.PERCENT_OF_ROW),))
    df = _table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    r = pivot(df, request, order_by=["o_orderkey"])
    return r.subtotals.join(r.columns, "column_index", "left").select("place", F.col("r0").alias("status"), F.col("c0").alias("year_label"), F.col("v0").cast("double").alias("share"))


_DRILL = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def drill_cell(spark, sf_dir):
    return drill_down(_table(spark, sf_dir, "lineitem"), FLAG_STATUS, ("R",), ("F",)).select(*_DRILL)


def drill_prefix(spark, sf_dir):
    return drill_down(_table(spark, sf_dir, "orders"), STATUS_PRIORITY, ("F",)).select("o_orderkey", "o_custkey", "o_totalprice")


def drill_total(spark, sf_dir):
    request = PivotRequest(("o_orderstatus",), ("o_orderpriority",), (Value("o_totalprice"),), (Filter("o_orderstatus", ("O",)),))
    return drill_down(_table(spark, sf_dir, "orders"), request, (), ("1-URGENT",)).select("o_orderkey", "o_custkey", "o_totalprice")


def drill_search(spark, sf_dir):
    rows = drill_down(_table(spark, sf_dir, "orders"), STATUS_PRIORITY, ("F",)).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return search(rows, "URG", {"o_orderstatus": ("F",)})


def distinct_text(spark, sf_dir):
    return distinct_values(_table(spark, sf_dir, "orders"), "o_orderpriority")


def distinct_numeric(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").withColumn("quantity", F.when(F.col("l_quantity") != 7, F.col("l_quantity")))
    return distinct_values(df, "quantity")


def page_slice(spark, sf_dir):
    r = pivot(_table(spark, sf_dir, "orders"), STATUS_PRIORITY, order_by=["o_orderkey"])
    p = page(r, 2, 4)
    rows = p.rows.join(p.cells, "row_index").select(F.col("row_index"), F.col("r0").alias("status"), F.col("r1").alias("priority"), F.col("v0").cast("double").alias("total"))
    subtotals = p.subtotals.where("column_index IS NULL").select(F.lit(None).cast("long").alias("row_index"), F.col("r0").alias("status"), F.lit(None).cast("string").alias("priority"), F.col("v0").cast("double").alias("total"))
    return rows.union(subtotals)


def wide_crosstab(spark, sf_dir):
    r = pivot(_table(spark, sf_dir, "lineitem"), FLAG_STATUS)
    out = wide(r)
    return out.select("row_index", F.col("r0").alias("row_label"), F.col("F").cast("double").alias("filled"), F.col("O").cast("double").alias("open"), F.col("row total").cast("double").alias("row_total"))


def conditional_highlight(spark, sf_dir):
    r = pivot(_table(spark, sf_dir, "orders"), CUSTOMER_PRIORITY, order_by=["o_orderkey"])
    rules = [Rule("<", 100_000, "red"), Rule("between", 900_000, "amber", 300_000), Rule(">=", 900_000, "green")]
    return r.labelled_cells().select(F.col("r0").alias("customer"), F.col("c0").alias("priority"), highlight(F.col("v0"), rules).alias("color"))


def _plan(collapsed):
    def run(spark, sf_dir):
        r = pivot(_table(spark, sf_dir, "orders"), STATUS_PRIORITY, order_by=["o_orderkey"])
        return row_plan(r, collapsed).select("position", "kind", "level", F.col("r0").alias("status"), F.col("r1").alias("priority"), F.col("v0").cast("double").alias("total"))

    return run


def header_groups(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return column_groups(pivot(df, PivotRequest((), ("o_orderpriority", "year"), (Value("o_totalprice"),)), order_by=["o_orderkey"]))


_CITIES = "city,amount\nZonguldak,1\nÇanakkale,2\nCorum,3\n"


def _collation(locale: str):
    def run(spark, sf_dir):
        return pivot(readers.csv_text(spark, _CITIES), PivotRequest(("city",), (), (Value("amount"),)), locale=locale).rows.withColumnRenamed("r0", "city")

    return run


def csv_source(spark, sf_dir):
    df = readers.csv_text(spark, 'region,year,amount\nEast,2024,"1,100.50"\n"West, far",2024,20\nEast,2025,\n')
    r = pivot(df, PivotRequest(("region",), ("year",), (Value("amount"),)))
    return _named(r.labelled_cells().drop("row_index", "column_index"), r, r0="region", c0="year_label")


def json_source(spark, sf_dir):
    df = readers.json_text(spark, '[{"region": "East", "year": 2024, "amount": 1.5}, {"region": "", "year": 2024, "amount": 2}, {"region": null, "year": 2025, "amount": 4}]')
    r = pivot(df, PivotRequest(("region",), ("year",), (Value("amount"), Value("region", A.COUNT))))
    return _named(r.labelled_cells().drop("row_index", "column_index"), r, r0="region", c0="year_label")


def records_source(spark, sf_dir):
    df = readers.records(spark, [{"region": "East", "ok": True, "amount": 1}, {"region": "East", "ok": False, "amount": 2}, {"region": "West", "amount": 4}])
    r = pivot(df, PivotRequest(("region",), ("ok",), (Value("amount"),)))
    return _named(r.labelled_cells().drop("row_index", "column_index"), r, r0="region", c0="ok_label")


QUERIES = {
    "pivot_sum_cells": pivot_sum_cells, "pivot_all_aggs": pivot_all_aggs, "pivot_multi_values": pivot_multi_values,
    "pivot_row_totals": pivot_row_totals, "pivot_column_totals": pivot_column_totals, "pivot_grand_total": pivot_grand_total, "pivot_metadata": pivot_metadata,
    "pivot_empty_grand_total": pivot_empty_grand_total, "pivot_subtotals": pivot_subtotals, "pivot_filter_in": pivot_filter_in, "pivot_filter_and": pivot_filter_and,
    "pivot_filter_blank": pivot_filter_blank, "pivot_label_double": pivot_label_double, "pivot_label_time": pivot_label_time, "pivot_column_order": pivot_column_order,
    "pivot_column_grid": pivot_column_grid, "pivot_rows_default_sort": pivot_rows_default_sort, "pivot_rows_label_desc": pivot_rows_label_desc,
    "pivot_rows_total_desc": pivot_rows_total_desc, "pivot_rows_column_value": pivot_rows_column_value,
    "showas_pct_row": _share(S.PERCENT_OF_ROW), "showas_pct_col": _share(S.PERCENT_OF_COLUMN), "showas_pct_grand": _share(S.PERCENT_OF_GRAND),
    "showas_diff_prev": _series(S.DIFFERENCE), "showas_pct_diff_prev": _series(S.PERCENT_DIFFERENCE), "showas_running_total": _series(S.RUNNING_TOTAL),
    "showas_running_max": _series(S.RUNNING_TOTAL, A.MAX), "showas_avg_pct_row": showas_avg_pct_row, "showas_subtotals": showas_subtotals,
    "drill_cell": drill_cell, "drill_prefix": drill_prefix, "drill_total": drill_total, "drill_search": drill_search,
    "distinct_text": distinct_text, "distinct_numeric": distinct_numeric, "page_slice": page_slice, "wide_crosstab": wide_crosstab,
    "row_plan": _plan(()), "row_plan_collapsed": _plan((("F",), ("P",))), "header_groups": header_groups,
    "conditional_highlight": conditional_highlight, "collation_order_tr": _collation("tr"), "collation_order_en": _collation("en"),
    "csv_source": csv_source, "json_source": json_source, "records_source": records_source,
}


def _exact(c: str) -> str:
    return f"CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,12))"


_SUM = f"CAST(sum({_exact('l_extendedprice')}) AS DOUBLE) AS l_extendedprice_sum"
_QTY = f"CAST(sum({_exact('l_quantity')}) AS DOUBLE) AS l_quantity_sum"
_DOUBLE_LABEL = "CASE WHEN {0} IS NULL THEN '' WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_T = f"sum({_exact('l_extendedprice')})"
_SHARES = f"""
    WITH c AS (SELECT l_returnflag r, l_linestatus c, CAST({_T} AS DOUBLE) v FROM lineitem GROUP BY 1, 2),
    rt AS (SELECT l_returnflag r, CAST({_T} AS DOUBLE) v FROM lineitem GROUP BY 1),
    ct AS (SELECT l_linestatus c, CAST({_T} AS DOUBLE) v FROM lineitem GROUP BY 1),
    g AS (SELECT CAST({_T} AS DOUBLE) v FROM lineitem)
    SELECT c.r AS row_label, c.c AS column_label, {{cell}} AS share FROM c JOIN rt ON c.r = rt.r JOIN ct ON c.c = ct.c, g
    UNION ALL SELECT rt.r, NULL, {{row}} FROM rt, g UNION ALL SELECT NULL, ct.c, {{column}} FROM ct, g UNION ALL SELECT NULL, NULL, 1.0 FROM g"""
_SERIES = f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) u, strftime(ts, '%Y-%m-%d') d, event_id, {_exact('value')} v FROM events),
    days AS (SELECT d, row_number() OVER (ORDER BY min(event_id)) i FROM e GROUP BY 1),
    raw AS (SELECT u, d, {{agg}}(v) v FROM e GROUP BY 1, 2 UNION ALL SELECT NULL, d, {{agg}}(v) FROM e GROUP BY 2)"""
_PREVIOUS = "last_value(v IGNORE NULLS) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RUNNING = (
    _SERIES
    + """,
    grid AS (SELECT u, days.d, i FROM (SELECT DISTINCT u FROM raw), days),
    run AS (SELECT g.u, g.d, sum(v) OVER (PARTITION BY g.u ORDER BY i) s FROM grid g LEFT JOIN raw ON g.d = raw.d AND g.u IS NOT DISTINCT FROM raw.u)
    SELECT u AS user_label, d AS day, CAST(s AS DOUBLE) AS shown FROM run WHERE s IS NOT NULL"""
)
_ORDER_TOTAL = "sum(" + _exact("o_totalprice") + ")"

_PLAN = f"""
    WITH d AS (SELECT o_orderstatus s, o_orderpriority p, CAST({_ORDER_TOTAL} AS DOUBLE) t FROM orders GROUP BY 1, 2),
    g AS (SELECT o_orderstatus s, CAST({_ORDER_TOTAL} AS DOUBLE) t FROM orders GROUP BY 1),
    a AS (SELECT 'detail' AS kind, 2 AS level, s, p, t FROM d WHERE s NOT IN ({{closed}}) UNION ALL SELECT 'group', 1, s, '', t FROM g
          UNION ALL SELECT 'grand', 0, '', '', CAST({_ORDER_TOTAL} AS DOUBLE) FROM orders)
    SELECT row_number() OVER (ORDER BY kind = 'grand', s, level, p) - 1 AS position, kind, level, s AS status, p AS priority, t AS total FROM a"""

ORACLE_SQL = {
    "row_plan": _PLAN.format(closed="''"),
    "row_plan_collapsed": _PLAN.format(closed="'F', 'P'"),
    "header_groups": """
        WITH p AS (SELECT o_orderpriority l, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS i FROM orders GROUP BY 1),
        y AS (SELECT CAST(year(o_orderdate) AS VARCHAR) l, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS j FROM orders GROUP BY 1), n AS (SELECT count(*) n FROM y)
        SELECT 0 AS level, i * n AS start, n AS span, l AS label FROM p, n UNION ALL SELECT 1, i * n + j, 1, y.l FROM p, y, n""",
    "pivot_sum_cells": f"SELECT l_returnflag AS row_label, l_linestatus AS column_label, {_SUM} FROM lineitem GROUP BY 1, 2",
    "pivot_all_aggs": f"SELECT l_returnflag AS row_label, l_linestatus AS column_label, {_QTY}, count(l_quantity) AS l_quantity_count, CAST(sum({_exact('l_quantity')}) AS DOUBLE) / count(l_quantity) AS l_quantity_average, CAST(min({_exact('l_quantity')}) AS DOUBLE) AS l_quantity_min, CAST(max({_exact('l_quantity')}) AS DOUBLE) AS l_quantity_max FROM lineitem GROUP BY 1, 2",
    "pivot_multi_values": f"SELECT l_returnflag AS row_label, l_linestatus AS column_label, {_SUM}, CAST(sum({_exact('l_discount')}) AS DOUBLE) / count(l_discount) AS l_discount_average, CAST(max({_exact('l_tax')}) AS DOUBLE) AS l_tax_max FROM lineitem GROUP BY 1, 2",
    "pivot_row_totals": f"SELECT row_number() OVER (ORDER BY l_returnflag) - 1 AS row_index, l_returnflag AS row_label, {_SUM} FROM lineitem GROUP BY l_returnflag",
    "pivot_column_totals": f"SELECT l_linestatus AS column_label, {_SUM} FROM lineitem GROUP BY 1",
    "pivot_grand_total": f"SELECT {_SUM}, count(*) AS source_rows FROM lineitem",
    "pivot_metadata": "SELECT count(*) AS source_rows, count(DISTINCT o_custkey) AS row_headers, count(DISTINCT o_orderpriority) AS column_headers, count(DISTINCT (o_custkey, o_orderpriority)) AS cell_count FROM orders",
    "pivot_empty_grand_total": "SELECT CAST(NULL AS DOUBLE) AS l_extendedprice_sum, CAST(0 AS BIGINT) AS l_quantity_count, CAST(0 AS BIGINT) AS source_rows",
    "pivot_subtotals": f"SELECT 1 AS level, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS place, o_orderstatus AS status, CAST({_ORDER_TOTAL} AS DOUBLE) AS o_totalprice_sum, count(o_orderkey) AS o_orderkey_count FROM orders GROUP BY o_orderstatus",
    "pivot_filter_in": f"SELECT l_returnflag AS row_label, l_linestatus AS column_label, {_SUM} FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2",
    "pivot_filter_and": f"SELECT l_returnflag AS row_label, l_linestatus AS column_label, {_QTY} FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'O' AND {_DOUBLE_LABEL.format('l_discount')} IN ('0.05', '0.06') GROUP BY 1, 2",
    "pivot_filter_blank": f"SELECT coalesce(nullif(l_returnflag, 'A'), '') AS row_label, l_linestatus AS column_label, {_QTY} FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2",
    "pivot_label_double": f"SELECT {_DOUBLE_LABEL.format('l_discount')} AS row_label, {_DOUBLE_LABEL.format('l_quantity')} AS column_label, count(l_extendedprice) AS l_extendedprice_count FROM lineitem GROUP BY 1, 2",
    "pivot_label_time": f"SELECT strftime(l_shipdate, '%m/%d/%Y %H:%M:%S') AS row_label, {_QTY} FROM lineitem GROUP BY 1",
    "pivot_column_order": "SELECT row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS column_index, o_orderpriority AS column_label FROM orders GROUP BY o_orderpriority",
    "pivot_column_grid": f"""
        WITH b AS (SELECT p_brand, min(p_partkey) o FROM part GROUP BY 1), s AS (SELECT p_size, min(p_partkey) o FROM part GROUP BY 1),
        t AS (SELECT p_brand, p_size, CAST(sum({_exact('p_retailprice')}) AS DOUBLE) v FROM part GROUP BY 1, 2)
        SELECT row_number() OVER (ORDER BY b.o, s.o) - 1 AS column_index, b.p_brand AS brand, CAST(s.p_size AS VARCHAR) AS size, v AS p_retailprice_sum
        FROM b CROSS JOIN s LEFT JOIN t ON t.p_brand = b.p_brand AND t.p_size = s.p_size""",
    "pivot_rows_default_sort": "SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS row_index, o_orderstatus AS r0, o_orderpriority AS r1 FROM orders GROUP BY 2, 3",
    "pivot_rows_label_desc": "SELECT row_number() OVER (ORDER BY o_orderpriority DESC, min(o_orderkey) DESC) - 1 AS row_index, o_orderstatus AS r0, o_orderpriority AS r1 FROM orders GROUP BY 2, 3",
    "pivot_rows_total_desc": f"SELECT row_number() OVER (ORDER BY {_ORDER_TOTAL} DESC, CAST(o_custkey AS VARCHAR)) - 1 AS row_index, CAST(o_custkey AS VARCHAR) AS r0 FROM orders GROUP BY o_custkey",
    "pivot_rows_column_value": f"SELECT row_number() OVER (ORDER BY sum(CASE WHEN o_orderpriority = '2-HIGH' THEN {_exact('o_totalprice')} END) ASC NULLS LAST, CAST(o_custkey AS VARCHAR)) - 1 AS row_index, CAST(o_custkey AS VARCHAR) AS r0 FROM orders GROUP BY o_custkey",
    "showas_pct_row": _SHARES.format(cell="c.v / rt.v", row="1.0", column="ct.v / g.v"),
    "showas_pct_col": _SHARES.format(cell="c.v / ct.v", row="rt.v / g.v", column="1.0"),
    "showas_pct_grand": _SHARES.format(cell="c.v / g.v", row="rt.v / g.v", column="ct.v / g.v"),
    "showas_diff_prev": _SERIES.format(agg="sum") + f" SELECT u AS user_label, raw.d AS day, CAST(v - {_PREVIOUS} AS DOUBLE) AS shown FROM raw JOIN days ON raw.d = days.d",
    "showas_pct_diff_prev": _SERIES.format(agg="sum") + f", p AS (SELECT u, raw.d, v, {_PREVIOUS} q FROM raw JOIN days ON raw.d = days.d) SELECT u AS user_label, d AS day, CASE WHEN q <> 0 THEN CAST(v - q AS DOUBLE) / CAST(q AS DOUBLE) END AS shown FROM p",
    "showas_running_total": _RUNNING.format(agg="sum"),
    "showas_running_max": _RUNNING.format(agg="max"),
    "showas_avg_pct_row": f"WITH c AS (SELECT l_returnflag r, l_linestatus c, CAST(sum({_exact('l_quantity')}) AS DOUBLE) / count(l_quantity) v FROM lineitem GROUP BY 1, 2), t AS (SELECT l_returnflag r, CAST(sum({_exact('l_quantity')}) AS DOUBLE) / count(l_quantity) v FROM lineitem GROUP BY 1) SELECT c.r AS row_label, c.c AS column_label, c.v / t.v AS l_quantity_average FROM c JOIN t ON c.r = t.r",
    "showas_subtotals": f"""
        WITH o AS (SELECT o_orderstatus s, CAST(year(o_orderdate) AS VARCHAR) y, {_exact('o_totalprice')} v, o_orderkey k FROM orders),
        p AS (SELECT s, row_number() OVER (ORDER BY min(k)) - 1 AS place, CAST(sum(v) AS DOUBLE) t FROM o GROUP BY s)
        SELECT place, o.s AS status, y AS year_label, CAST(sum(v) AS DOUBLE) / min(t) AS share FROM o JOIN p ON o.s = p.s GROUP BY 1, 2, 3
        UNION ALL SELECT place, s, NULL, CASE WHEN t <> 0 THEN 1.0 END FROM p""",
    "drill_cell": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
    "drill_prefix": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "drill_total": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
    "drill_search": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%urg%'",
    "distinct_text": "SELECT o_orderpriority AS value, row_number() OVER (ORDER BY o_orderpriority) - 1 AS position FROM orders GROUP BY 1",
    "distinct_numeric": f"WITH q AS (SELECT DISTINCT CASE WHEN l_quantity <> 7 THEN l_quantity END x FROM lineitem) SELECT {_DOUBLE_LABEL.format('x')} AS value, row_number() OVER (ORDER BY x NULLS FIRST) - 1 AS position FROM q",
    "page_slice": f"""
        WITH h AS (SELECT o_orderstatus s, o_orderpriority p, CAST({_ORDER_TOTAL} AS DOUBLE) v, row_number() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS i FROM orders GROUP BY 1, 2),
        pg AS (SELECT * FROM h WHERE i BETWEEN 2 AND 5)
        SELECT i - 2 AS row_index, s AS status, p AS priority, v AS total FROM pg
        UNION ALL SELECT NULL, o_orderstatus, NULL, CAST({_ORDER_TOTAL} AS DOUBLE) FROM orders WHERE o_orderstatus IN (SELECT s FROM pg) GROUP BY 2""",
    "wide_crosstab": f"SELECT row_number() OVER (ORDER BY l_returnflag) - 1 AS row_index, l_returnflag AS row_label, CAST(sum(CASE WHEN l_linestatus = 'F' THEN {_exact('l_extendedprice')} END) AS DOUBLE) AS filled, CAST(sum(CASE WHEN l_linestatus = 'O' THEN {_exact('l_extendedprice')} END) AS DOUBLE) AS open, CAST({_T} AS DOUBLE) AS row_total FROM lineitem GROUP BY l_returnflag",
    "conditional_highlight": f"WITH c AS (SELECT CAST(o_custkey AS VARCHAR) customer, o_orderpriority AS priority, CAST({_ORDER_TOTAL} AS DOUBLE) v FROM orders GROUP BY 1, 2) SELECT customer, priority, CASE WHEN v >= 900000 THEN 'green' WHEN v BETWEEN 300000 AND 900000 THEN 'amber' WHEN v < 100000 THEN 'red' END AS color FROM c",
    "collation_order_tr": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'Corum'), (1, 'Çanakkale'), (2, 'Zonguldak')) t(row_index, city)",
    "collation_order_en": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'Çanakkale'), (1, 'Corum'), (2, 'Zonguldak')) t(row_index, city)",
    "csv_source": "SELECT * FROM (VALUES ('East', '2024', CAST(1100.5 AS DOUBLE)), ('West, far', '2024', 20), ('East', '2025', NULL)) t(region, year_label, amount_sum)",
    "json_source": "SELECT * FROM (VALUES ('East', '2024', CAST(1.5 AS DOUBLE), CAST(1 AS BIGINT)), ('', '2024', 2, 1), ('', '2025', 4, 0)) t(region, year_label, amount_sum, region_count)",
    "records_source": "SELECT * FROM (VALUES ('East', 'True', CAST(1 AS DOUBLE)), ('East', 'False', 2), ('West', '', 4)) t(region, ok_label, amount_sum)",
}
