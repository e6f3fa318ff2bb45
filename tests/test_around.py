"""Drill-down, distinct values, paging, sessions, sources, sinks, display, layout and streams."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from crossloom.functions.display import Format, Rule, filter_summary, highlight
from crossloom.operators.aggregate import distinct_values
from crossloom.operators.drill import drill_down, limited, search
from crossloom.operators.paging import page
from crossloom.plans.engine import pivot
from crossloom.plans.errors import PivotError, SessionExpiredError
from crossloom.plans.layout import Field, Layout, ViewStore, picked, set_shown
from crossloom.plans.request import Aggregation as A, Filter, PivotRequest, RowSort, ShowAs as S, SortBy, Value
from crossloom.plans.session import Options, PivotService
from crossloom.sources import readers, sinks
from crossloom.streaming.incremental import windowed_cells

ROWS = [("East", "A", 2026, 100), ("East", "A", 2026, 50), ("East", "B", 2025, 7), ("West", "A", 2026, 9), ("West", "B", 2025, 1)]
REQUEST = PivotRequest(("region", "category"), ("year",), (Value("amount"),))


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(ROWS, "region string, category string, year int, amount int")


def amounts(df):
    return sorted(r["amount"] for r in df.collect())


def test_drill(sales):
    assert amounts(drill_down(sales, REQUEST, ("East", "A"), ("2026",))) == [50, 100]
    assert amounts(drill_down(sales, REQUEST, ("East",))) == [7, 50, 100]
    assert amounts(drill_down(sales, REQUEST, (), ("2026",))) == [9, 50, 100]
    assert drill_down(sales, REQUEST).count() == 5
    only_a = PivotRequest(REQUEST.rows, REQUEST.columns, REQUEST.values, (Filter("CATEGORY", ("A",)),))
    assert drill_down(sales, only_a).count() == 3
    assert drill_down(sales, REQUEST, (None,)).count() == 0
    with pytest.raises(PivotError):
        drill_down(sales, REQUEST, ("East", "A", "x"))
    rows, total, cut = limited(drill_down(sales, REQUEST), 2)
    assert (rows.count(), total, cut) == (2, 5, True)


def test_search(sales):
    assert amounts(search(sales, "eAST", {"year": ("2026",)})) == [50, 100]
    assert search(sales, " ").count() == 5


def test_distinct_values(spark):
    values = lambda df, f, **o: [r["value"] for r in distinct_values(df, f, **o).orderBy("position").collect()]
    assert values(spark.createDataFrame([(2,), (10,), (1,), (None,)], "n int"), "N") == ["", "1", "2", "10"]
    assert values(spark.createDataFrame([("South",), ("North",), ("North",), ("East",)], "k string"), "k", limit=2) == ["East", "North"]
    assert distinct_values(spark.createDataFrame([("b",), ("a",)], "k string"), "k", limit=1).first()["total"] == 2


def test_page(spark):
    df = spark.createDataFrame([(f"R{i // 2}", str(i % 2), i) for i in range(5)], "a string, b string, v int")
    r = pivot(df, PivotRequest(("a", "b"), (), (Value("v"),)))
    p = page(r, 2, 2)
    assert [(x["row_index"], x["r0"], x["r1"]) for x in p.rows.orderBy("row_index").collect()] == [(0, "R1", "0"), (1, "R1", "1")]
    assert sorted(x["row_index"] for x in p.cells.collect()) == [0, 1] and p.has_previous and p.has_more
    assert {x["r0"] for x in p.subtotals.collect()} == {"R1"}
    end = page(r, 99, 2)
    assert (end.offset, end.rows.count(), end.has_more) == (5, 0, False)
    for offset, size in ((-1, 2), (0, 0), (0, 1001)):
        with pytest.raises(PivotError):
            page(r, offset, size)


def test_sessions_share_one_computation(spark, sales):
    calls, now = [], [0.0]
    service = PivotService(spark, lambda s, hint: calls.append(hint) or sales, clock=lambda: now[0])
    one, first, there = service.start(REQUEST, hint=5, page_size=10)
    two, _, again = service.start(REQUEST, hint=5, page_size=20)
    assert one == two and (there, again) == (False, True) and calls == [1000] and first.size == 4
    assert re.fullmatch("[0-9a-f]{64}", one)
    now[0] = 299
    assert service.page(one, 1, 10).offset == 1
    now[0] = 700
    with pytest.raises(SessionExpiredError):
        service.page(one, 0, 10)
    assert PivotService(spark, lambda s, h: sales, locale="tr").start(REQUEST)[0] != one
    with pytest.raises(PivotError):
        Options(drill_limit=0)


def test_csv(spark):
    df = readers.csv_text(spark, 'region,year,amount\r\nEast,2024,"1,100.5"\n\n"a ""q"", b",2026,\nshort\n')
    assert [tuple(r) for r in df.select("region", "year", F.col("amount").cast("double")).collect()] == [("East", 2024, 1100.5), (None, None, None), ('a "q", b', 2026, None), ("short", None, None)]


def test_csv_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,v\n"a, b","1,000"\nc,\nd,x\n')
    assert [tuple(r) for r in readers.csv_files(spark, str(tmp_path), ["V"]).select("k", F.col("v").cast("double")).collect()] == [("a, b", 1000.0), ("c", None), ("d", None)]


def test_json(spark, tmp_path):
    assert [tuple(r) for r in readers.json_text(spark, '[{"a": "", "n": 1}, {"n": 2.5}]').collect()] == [("", 1.0), (None, 2.5)]
    for bad in ('{"a": 1}', "[1]", '[{"a": {"b": 1}}]', '[{"a": 1, "A": 2}]', "[]"):
        with pytest.raises(PivotError):
            readers.json_text(spark, bad)
    assert readers.json_text(spark, "[]", "a string").count() == 0
    (tmp_path / "x.json").write_text('[{"a": "x", "n": 1.5}, {"a": "y"}]')
    assert readers.json_files(spark, str(tmp_path)).where("n IS NULL").count() == 1


def test_display(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert show(Format(decimals=1).column(F.lit(1234.56))) == "1,234.6"
    assert show(Format("percent", 1).column(F.lit(0.25), S.PERCENT_OF_ROW)) == "25.0%" and show(Format("percent", 0).column(F.lit(25.0))) == "25%"
    assert [Format().excel(), Format("currency", 0).excel(), Format("percent", 1).excel()] == ["#,##0.00", "₺#,##0", "0.0%"]
    rules = [Rule(">", 5, "red"), Rule("between", 12, "blue", 8)]
    assert [show(highlight(F.lit(v).cast("double"), rules)) for v in (10, 6, 1, None)] == ["blue", "red", None, None]
    assert filter_summary([Filter("k", tuple("abcdefgh")), Filter("x", ())]) == "k: a, b, c, d, e, f +2"
    with pytest.raises(PivotError):
        Rule("between", 1, "red")


def test_sinks(spark, sales, tmp_path):
    r = pivot(sales, REQUEST)
    table = sinks.wide(r)
    assert {(x["r0"], x["r1"], x["row total"]) for x in table.collect()} == {("East", "A", 150), ("East", "B", 7), ("West", "A", 9), ("West", "B", 1)}
    text = sinks.csv_text(spark.createDataFrame([('a "q"', 1), (None, 2)], "k string, v int"))
    assert text == '﻿k,v\n"a ""q""",1\n,2'
    assert sinks.tab_row(spark.createDataFrame([("a", 1)], "k string, v int")).first()[0] == "a\t1"
    sinks.write_csv(table, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4
    assert sinks.as_json(r)["cells"].count() == 4


def test_workbook(sales):
    doc = sinks.document(pivot(sales, REQUEST), "T", {"amount_sum": Format(decimals=0)}, {"amount_sum": [Rule(">", 100, "#FF0000")]})
    doc.sheet = "a/b"
    book = zipfile.ZipFile(io.BytesIO(sinks.workbook(doc)))
    sheet, styles = book.read("xl/worksheets/sheet1.xml").decode(), book.read("xl/styles.xml").decode()
    assert 'name="ab"' in book.read("xl/workbook.xml").decode()
    assert '<pane xSplit="2" ySplit="5" topLeftCell="C6"' in sheet and '<mergeCell ref="A4:B4"/>' in sheet and "<v>150.0</v>" in sheet
    assert 'formatCode="#,##0"' in styles and "FFFF0000" in styles
    assert sinks.a1(1, 28) == "AB1" and sinks.sheet_name("[]") == "Pivot"


def test_layout(tmp_path):
    layout = Layout([Field("region", area="row"), Field("year"), Field("amount", area="data"), Field("tax", role="measure")])
    layout.move("year", "column")
    layout.move("tax", "data", 0)
    layout.change("amount", aggregation=A.AVERAGE)
    layout.set_filter("region", ["East", None])
    request = layout.request()
    assert request == PivotRequest(("region",), ("year",), (Value("tax"), Value("amount", A.AVERAGE)), (Filter("region", ("East", "")),))
    layout.sort_by_header(RowSort(SortBy.ROW_TOTAL, value_key="tax_sum"))
    layout.sort_by_header(RowSort(SortBy.ROW_TOTAL, value_key="tax_sum"))
    assert layout.sort.descending
    assert layout.filter_by_cell(["West"], ["2026"]).filters == (Filter("region", ("West",)), Filter("year", ("2026",)))
    again = Layout.from_json(layout.to_json(), layout)
    assert again.request() == layout.request()
    assert Layout.from_json('{"version": 9}', layout) is layout
    layout.remove("tax")
    assert layout.sort == RowSort()
    for wrong in (lambda: layout.remove("amount"), lambda: layout.move("region", "data"), lambda: layout.change("region", show_as=S.NORMAL), lambda: layout.get("x")):
        with pytest.raises(PivotError):
            wrong()
    store = ViewStore(tmp_path / "views.json")
    key = store.save("Mine", layout, [Rule(">", 1, "red")], {"a": 1000})
    assert store.save("mine", layout) == key and store.list()[0]["widths"] == {} and store.delete(key) and not store.list()
    assert Layout([Field("k"), Field("v", area="data")]).repaired().request().rows == ("k",)


def test_picker():
    assert picked(["a", "b"], {"a", "b"}) == [] and picked(["a", "b"], {"a"}) == ["a"] and picked(["a"], {"a"}, {"z"}) == ["a", "z"]
    assert set_shown(["East", "West"], {"West"}, "ea", True) == {"East", "West"}


def test_stream_cells(spark, tmp_path):
    spark.createDataFrame([("x", "2024-01-01 10:00:00", 1), ("x", "2024-01-01 11:00:00", 2), ("y", "2024-01-05 00:00:00", 4)], "k string, t string, v int").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k string, t timestamp, v int").parquet(str(tmp_path / "s"))
    out = windowed_cells(stream, PivotRequest(("k",), (), (Value("v"),)), "t")
    query = out.writeStream.format("memory").queryName("cells").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r["r0"], int(r["v0"])) for r in spark.table("cells").collect()] == [("x", 3)]


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_row_plan_and_headers(sales, spark):
    from crossloom.operators.rowplan import all_groups, column_groups, detail_title, detail_view, row_plan

    r = pivot(sales, REQUEST)
    rows = [tuple(x)[1:] for x in row_plan(r).orderBy("position").collect()]
    assert [(k, a, b, int(v)) for k, _, a, b, v in rows] == [
        ("group", "East", "", 157), ("detail", "East", "A", 150), ("detail", "East", "B", 7), ("group", "West", "", 10), ("detail", "West", "A", 9), ("detail", "West", "B", 1), ("grand", "", "", 167),
    ]
    assert [x["kind"] for x in row_plan(r, [("East",)]).orderBy("position").collect()] == ["group", "group", "detail", "detail", "grand"]
    assert {x["key"] for x in all_groups(r).collect()} == {"East", "West"}
    by_value = pivot(sales, PivotRequest(REQUEST.rows, REQUEST.columns, REQUEST.values, (), RowSort(SortBy.ROW_TOTAL, True, value_key="amount_sum")))
    assert [(x["r0"], x["r1"]) for x in row_plan(by_value).where("kind = 'detail'").orderBy("position").collect()] == [("East", "A"), ("East", "B"), ("West", "A"), ("West", "B")]
    heads = column_groups(pivot(sales, PivotRequest((), ("category", "year"), REQUEST.values))).collect()
    assert sorted((h["level"], h["start"], h["span"]) for h in heads) == [(0, 0, 2), (0, 2, 2), (1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 3, 1)]
    assert detail_view(sales, {"AMOUNT": "Amount due", "x": "y"}).columns == ["Amount due"] and detail_title(["East", ""], [], "Sum") == "East / - / Sum"


def test_page_reader_restarts_an_expired_session(spark, sales):
    from crossloom.plans.session import PageReader

    now = [0.0]
    reader = PageReader(PivotService(spark, lambda s, h: sales, clock=lambda: now[0]), REQUEST, size=10)
    assert len(reader.rows(3)) == 4
    now[0] = 10_000
    assert len(reader.rows(3)) == 4 and reader.rows(13) == [] and len(reader.pages) == 1
