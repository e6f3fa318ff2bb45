"""The pivot engine against small hand-made results."""

import pytest
from pyspark.sql import functions as F

from crossloom.plans.engine import pivot
from crossloom.plans.errors import FieldNotFoundError, FieldTypeError, PivotError
from crossloom.plans.request import Aggregation as A, Filter, PivotRequest, RowSort, ShowAs as S, SortBy, Value

AMOUNT = Value("Amount")


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(0, "East", 2026, "A", 100.0), (1, "East", 2026, "A", 50.0), (2, "West", 2026, "B", 25.0), (3, "East", 2025, "A", 10.0)]
    return spark.createDataFrame(rows, "n int, Region string, Year int, Category string, Amount double")


def cells(result):
    keys = len(result.request.values)
    names = [f"r{i}" for i in range(len(result.request.rows))] + [f"c{i}" for i in range(len(result.request.columns))]
    return {tuple(r[n] for n in names): tuple(None if r[f"v{i}"] is None else float(r[f"v{i}"]) for i in range(keys)) for r in result.labelled_cells().collect()}


def ordered(df, index):
    return [tuple(r)[1:] for r in df.orderBy(index).collect()]


def test_sum_with_missing_cells(orders):
    r = pivot(orders, PivotRequest(("Region",), ("Year",), (AMOUNT,)), order_by=["n"])
    assert cells(r) == {("East", "2026"): (150.0,), ("West", "2026"): (25.0,), ("East", "2025"): (10.0,)}
    assert float(r.grand.first()["v0"]) == 185
    assert tuple(r.metadata().first()) == (4, 2, 2, 3)
    assert ordered(r.columns, "column_index") == [("2026",), ("2025",)]  # first appearance, not sorted


def test_aggregations_pass_over_null(spark):
    df = spark.createDataFrame([("x", 100.0), ("x", 50.0), ("x", None)], "k string, Amount double")
    r = pivot(df, PivotRequest(("k",), (), tuple(Value("Amount", a) for a in (A.COUNT, A.AVERAGE, A.MIN, A.MAX))))
    assert [float(x) for x in r.grand.first()[:4]] == [2, 75, 50, 100]


def test_empty_source_has_a_grand_total(orders):
    r = pivot(orders.limit(0), PivotRequest(("Region",), ("Year",), (AMOUNT, Value("Amount", A.COUNT))))
    assert tuple(r.grand.first()) == (None, 0, 0)
    assert r.rows.count() == r.columns.count() == r.cells.count() == 0


def test_blank_and_null_are_one_label(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("x", 4)], "k string, v int")
    r = pivot(df, PivotRequest(("k",), (), (Value("v"),), (Filter("k", ("", None)),)))
    assert cells(r) == {("",): (3.0,)}


def test_labels_by_type(spark):
    df = spark.sql("SELECT 17D AS d, 1.5D AS e, true AS b, timestamp_ntz'2024-01-02 03:04:05' AS t, date'2024-01-02' AS u, 12.50BD AS m, 1 AS v")
    r = pivot(df, PivotRequest(("d", "e", "b", "t", "u", "m"), (), (Value("v"),)))
    assert ordered(r.rows, "row_index") == [("17", "1.5", "True", "01/02/2024 03:04:05", "01/02/2024", "12.50")]


def test_filters_are_pushed_down(spark, tmp_path, orders):
    orders.write.parquet(str(tmp_path / "o"))
    from crossloom.operators.filters import apply_filters

    df = apply_filters(spark.read.parquet(str(tmp_path / "o")), [Filter("region", ("East", "West")), Filter("Year", ("2026", "x", "02026"))])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(Region, [East,West])" in plan and "EqualTo(Year,2026)" in plan
    assert df.count() == 3


def test_wrong_requests(orders):
    for request, error in (
        (PivotRequest(("Nope",), (), (AMOUNT,)), FieldNotFoundError),
        (PivotRequest((), (), (AMOUNT,), (Filter("Nope", ()),)), FieldNotFoundError),
        (PivotRequest((), (), (Value("Region"),)), FieldTypeError),
        (PivotRequest(("Region",), (), ()), PivotError),
        (PivotRequest((), (), (AMOUNT, Value("Amount", A.SUM, S.RUNNING_TOTAL))), PivotError),
        (PivotRequest((" ",), (), (AMOUNT,)), PivotError),
    ):
        with pytest.raises(error):
            pivot(orders, request)


def test_not_a_number_raises(spark):
    df = spark.createDataFrame([("x", float("nan"))], "k string, v double")
    with pytest.raises(Exception, match="not finite"):
        pivot(df, PivotRequest(("k",), (), (Value("v"),))).grand.collect()


def test_column_grid_is_a_product(spark):
    df = spark.createDataFrame([(0, 2024, "Marmara", 1), (1, 2024, "Ege", 1), (2, 2025, "Akdeniz", 1)], "n int, y int, r string, v int")
    r = pivot(df, PivotRequest((), ("y", "r"), (Value("v"),)), order_by=["n"])
    assert ordered(r.columns, "column_index") == [(y, x) for y in ("2024", "2025") for x in ("Marmara", "Ege", "Akdeniz")]
    with pytest.raises(PivotError, match="6 columns"):
        pivot(df, PivotRequest((), ("y", "r"), (Value("v"),)), max_columns=5)


@pytest.mark.parametrize(
    ("sort", "want"),
    [
        (RowSort(SortBy.ROW_LABEL, True), ["Sand", "Gravel", "Concrete"]),
        (RowSort(SortBy.ROW_TOTAL, True, value_key="v_sum"), ["Gravel", "Concrete", "Sand"]),
        (RowSort(SortBy.COLUMN_VALUE, True, value_key="v_sum", column_path=("2025",)), ["Sand", "Gravel", "Concrete"]),
        (RowSort(SortBy.COLUMN_VALUE, False, value_key="v_sum", column_path=()), ["Concrete", "Gravel", "Sand"]),
        (RowSort(SortBy.ROW_TOTAL, False, value_key="unknown"), ["Concrete", "Gravel", "Sand"]),
        (RowSort(SortBy.ROW_TOTAL), ["Concrete", "Sand", "Gravel"]),
    ],
)
def test_row_orders(spark, sort, want):
    rows = [(0, "Concrete", 2024, 150), (1, "Sand", 2025, 25), (2, "Gravel", 2025, 10), (3, "Gravel", 2024, 490)]
    df = spark.createDataFrame(rows, "n int, k string, y int, v int")
    r = pivot(df, PivotRequest(("k",), ("y",), (Value("v"),), (), sort), order_by=["n"])
    assert [x for (x,) in ordered(r.rows, "row_index")] == want


def test_descending_labels_turn_ties_round(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "c", "y")], "n int, j string, k string")
    request = PivotRequest(("j", "k"), (), (Value("n"),), (), RowSort(SortBy.ROW_LABEL, True, "K"))
    assert ordered(pivot(df, request, order_by=["n"]).rows, "row_index") == [("c", "y"), ("b", "x"), ("a", "x")]


def test_many_rows_are_numbered_by_a_distributed_sort(spark):
    from crossloom.operators.ordering import numbered

    df = spark.range(1000).repartition(7)
    got = numbered(df, [F.col("id").desc()], "at", size=1 << 30).collect()
    assert sorted((r["at"], r["id"]) for r in got) == [(i, 999 - i) for i in range(1000)]


def test_no_axis_level_is_numbered_in_one_window_if_it_is_large(spark, monkeypatch):
    from crossloom.operators import ordering

    df = spark.createDataFrame([(n, f"a{n * 7 % 5}", f"b{n * 3 % 4}", f"c{n % 4}", f"d{n * 5 % 3}") for n in range(60)], "n int, a string, b string, c string, d string")
    request = PivotRequest(("a", "b"), ("c", "d"), (Value("n"),))
    run = lambda: pivot(df, request, order_by=["n"])
    rows = lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)
    small = run()
    monkeypatch.setattr(ordering, "ONE_WINDOW", 2)
    large = run()
    for name in ("rows", "columns", "cells", "subtotals"):
        assert rows(getattr(large, name)) == rows(getattr(small, name))
        assert "row_number()" not in getattr(large, name)._jdf.queryExecution().analyzed().toString()


SHARES = [("East", 2024, 100), ("East", 2025, 300), ("West", 2024, 100), ("West", 2025, 100)]


@pytest.mark.parametrize(
    ("show", "east", "row", "column", "grand"),
    [
        (S.PERCENT_OF_ROW, (0.25, 0.75), 1.0, 200 / 600, 1.0),
        (S.PERCENT_OF_COLUMN, (0.5, 0.75), 400 / 600, 1.0, 1.0),
        (S.PERCENT_OF_GRAND, (100 / 600, 300 / 600), 400 / 600, 200 / 600, 1.0),
        (S.DIFFERENCE, (None, 200.0), None, None, None),
        (S.RUNNING_TOTAL, (100.0, 400.0), 400.0, 200.0, 600.0),
    ],
)
def test_show_as(spark, show, east, row, column, grand):
    df = spark.createDataFrame(SHARES, "r string, y int, v int")
    got = pivot(df, PivotRequest(("r",), ("y",), (Value("v", A.SUM, show),)), order_by=["y", "r"])
    number = lambda v: None if v is None else pytest.approx(float(v))
    found = cells(got)
    assert (found["East", "2024"][0], found["East", "2025"][0]) == tuple(None if x is None else pytest.approx(x) for x in east)
    assert number(got.row_totals.where("row_index = 0").first()["v0"]) == row
    assert number(got.column_totals.where("column_index = 0").first()["v0"]) == column
    assert number(got.grand.first()["v0"]) == grand


def test_running_total_is_carried(spark):
    df = spark.createDataFrame([(0, "East", 2024, 100), (1, "West", 2025, 20), (2, "East", 2026, 50)], "n int, r string, y int, v int")
    got = cells(pivot(df, PivotRequest(("r",), ("y",), (Value("v", A.SUM, S.RUNNING_TOTAL), Value("v", A.COUNT))), order_by=["n"]))
    assert got == {("East", "2024"): (100, 1), ("East", "2025"): (100, None), ("East", "2026"): (150, 1), ("West", "2025"): (20, 1), ("West", "2026"): (20, None)}


def test_difference_passes_over_gaps_and_sorts_nulls_last(spark):
    rows = [(0, "A", 2024, 10), (1, "B", 2024, 10), (2, "C", 2025, 5), (3, "A", 2026, 30), (4, "B", 2026, 90)]
    df = spark.createDataFrame(rows, "n int, k string, y int, v int")
    sort = RowSort(SortBy.COLUMN_VALUE, True, value_key="v_sum", column_path=("2026",))
    r = pivot(df, PivotRequest(("k",), ("y",), (Value("v", A.SUM, S.DIFFERENCE),), (), sort), order_by=["n"])
    assert cells(r)["A", "2026"] == (20,) and cells(r)["C", "2025"] == (None,)
    assert [x for (x,) in ordered(r.rows, "row_index")] == ["B", "A", "C"]


def test_share_of_an_average_comes_from_source_rows(spark):
    df = spark.createDataFrame([("p", 2024, 100.0), ("p", 2025, 20.0), ("p", 2025, 20.0), ("p", 2025, 20.0)], "p string, y int, v double")
    got = cells(pivot(df, PivotRequest(("p",), ("y",), (Value("v", A.AVERAGE, S.PERCENT_OF_ROW),))))
    assert got == {("p", "2024"): (2.5,), ("p", "2025"): (0.5,)}


def test_zero_total_gives_null(spark):
    df = spark.createDataFrame([("x", "y", 0)], "r string, c string, v int")
    r = pivot(df, PivotRequest(("r",), ("c",), (Value("v", A.SUM, S.PERCENT_OF_GRAND),)))
    assert cells(r) == {("x", "y"): (None,)} and r.grand.first()["v0"] is None


def test_subtotals(orders):
    r = pivot(orders, PivotRequest(("Region", "Category"), ("Year",), (AMOUNT,)), order_by=["n"])
    got = {(x["r0"], x["column_index"]): float(x["v0"]) for x in r.subtotals.collect()}
    assert got == {("East", 0): 150, ("East", 1): 10, ("East", None): 160, ("West", 0): 25, ("West", None): 25}


@pytest.mark.parametrize(("locale", "want"), [("tr-TR", ["Corum", "Çanakkale", "Zonguldak"]), ("en-US", ["Çanakkale", "Corum", "Zonguldak"])])
def test_culture_orders_rows(spark, locale, want):
    df = spark.createDataFrame([("Zonguldak", 1), ("Çanakkale", 1), ("Corum", 1)], "k string, v int")
    assert [x for (x,) in ordered(pivot(df, PivotRequest(("k",), (), (Value("v"),)), locale=locale).rows, "row_index")] == want


def test_small_and_long_numbers_are_exact(spark):
    from decimal import Decimal

    from crossloom.sources.readers import csv_text, json_text

    df = spark.createDataFrame([("a", 0.00004, 1), ("a", 0.00005, 2), ("b", 1e-13, 3)], "r string, v double, o int")
    own = tuple(Value("v", kind) for kind in (A.SUM, A.MIN, A.MAX, A.AVERAGE))
    rows = {r["r0"]: [float(r[f"v{i}"]) for i in range(4)] for r in pivot(df, PivotRequest(("r",), (), own), order_by=["o"]).labelled_cells().collect()}
    assert rows["a"] == [0.00009, 0.00004, 0.00005, 0.000045] and rows["b"][1:3] == [1e-13, 1e-13]
    found = json_text(spark, '[{"k": 9007199254740993}, {"k": 0.00001}, {"k": null}]')
    assert sum(r["k"] for r in found.collect() if r["k"] is not None) == Decimal("9007199254740993.00001")
    assert [r["k"] for r in json_text(spark, '[{"k": 99999999999999999999}]').collect()] == [99999999999999999999]
    assert [r["k"] for r in csv_text(spark, "k,l\n0.12345678,1\n-3,2\n").collect()] == [Decimal("0.12345678"), Decimal("-3.00000000")]


def test_source_rows_are_read_once_and_not_expanded(spark, tmp_path, orders):
    import re

    orders.write.parquet(str(tmp_path / "o"))
    request = PivotRequest(("Region", "Category"), ("Year",), (AMOUNT, Value("Amount", A.AVERAGE), Value("Amount", A.COUNT)))
    r = pivot(spark.read.parquet(str(tmp_path / "o")), request, order_by=["n"])
    got = [float(x) for x in r.grand.first()]
    assert got == [185, 46.25, 4, 4]
    text = r.held[0]._jdf.queryExecution().optimizedPlan().toString() + r.held[0]._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text
    for frame in (r.cells, r.row_totals, r.column_totals, r.subtotals, r.grand):
        # Every scan of the files is the one that fills the kept cells.
        plan = frame._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and not re.search(r"^[\s:+|-]*Relation \[", plan, re.M)
    r.release()
    assert not r.held


def test_totals_from_cells_equal_totals_from_rows(spark):
    rows = [(i, f"a{i % 3}", f"b{i % 4}", f"c{i % 2}", None if i % 7 == 0 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, a string, b string, c string, v int")
    r = pivot(df, PivotRequest(("a", "b"), ("c",), tuple(Value("v", k) for k in A)), order_by=["n"])
    plain = {k: (F.sum, F.count, F.avg, F.min, F.max)[i]("v") for i, k in enumerate((A.SUM, A.COUNT, A.AVERAGE, A.MIN, A.MAX))}
    want = [float(x) for x in df.agg(*(plain[k] for k in A)).first()]
    assert [float(x) for x in r.grand.first()[: len(A)]] == pytest.approx(want)
    by_a = {x["a"]: [float(x[i + 1]) for i in range(len(A))] for x in df.groupBy("a").agg(*(plain[k] for k in A)).collect()}
    got = {x["r0"]: [float(x[f"v{i}"]) for i in range(len(A))] for x in r.subtotals.where("column_index IS NULL").collect()}
    assert got == {k: pytest.approx(v) for k, v in by_a.items()}
