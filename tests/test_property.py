"""Random small sources against a plain pivot in Python."""

from collections import defaultdict
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from crossloom.plans.engine import pivot
from crossloom.plans.request import Aggregation as A, Filter, PivotRequest, ShowAs as S, Value

ROW = st.tuples(st.sampled_from(["a", "B", "", None, "ç"]), st.sampled_from(["x", "y", None]), st.sampled_from([1, 2, 30]), st.one_of(st.none(), st.integers(-50, 50)))


def aggregates(values):
    seen = [v for v in values if v is not None]
    if not seen:
        return (None, 0, None, None, None)
    return (sum(seen), len(seen), sum(seen) / len(seen), min(seen), max(seen))


def plain(rows, accept):
    cells, totals, columns, prefixes, order = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list), []
    for r, s, c, v in rows:
        r, s, c = r or "", s or "", str(c)
        if accept and r not in accept:
            continue
        cells[r, s, c].append(v)
        totals[r, s].append(v)
        columns[c].append(v)
        prefixes[r].append(v)
        if c not in order:
            order.append(c)
    return cells, totals, columns, prefixes, order


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, max_size=14), st.sampled_from([(), ("a", ""), ("ç",)]))
def test_pivot_against_plain(spark, rows, accept):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, r string, s string, c int, v int")
    request = PivotRequest(("r", "s"), ("c",), tuple(Value("v", a) for a in A), (Filter("r", accept),))
    got = pivot(df, request, order_by=["n"])
    cells, totals, columns, prefixes, order = plain(rows, accept)
    number = lambda t: tuple(None if x is None else float(x) for x in t)
    values = lambda row: number(row[f"v{i}"] for i in range(5))
    assert {(x["r0"], x["r1"], x["c0"]): values(x) for x in got.labelled_cells().collect()} == {k: number(aggregates(v)) for k, v in cells.items()}
    assert {(x["r0"], x["r1"]): values(x) for x in got.row_totals.join(got.rows, "row_index").collect()} == {k: number(aggregates(v)) for k, v in totals.items()}
    assert {x["c0"]: values(x) for x in got.column_totals.join(got.columns, "column_index").collect()} == {k: number(aggregates(v)) for k, v in columns.items()}
    assert {x["r0"]: values(x) for x in got.subtotals.where("column_index IS NULL").collect()} == {k: number(aggregates(v)) for k, v in prefixes.items()}
    assert [x["c0"] for x in got.columns.orderBy("column_index").collect()] == order
    assert values(got.grand.first()) == number(aggregates([v for own in cells.values() for v in own]))
    got.release()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=1, max_size=14), st.sampled_from([S.DIFFERENCE, S.PERCENT_DIFFERENCE, S.RUNNING_TOTAL, S.PERCENT_OF_ROW, S.PERCENT_OF_COLUMN]))
def test_show_as_against_plain(spark, rows, show):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, r string, s string, c int, v int")
    got = pivot(df, PivotRequest(("r",), ("c",), (Value("v", A.SUM, show),)), order_by=["n"])
    raw, per_row, per_column, order = defaultdict(list), defaultdict(list), defaultdict(list), []
    for r, _, c, v in rows:
        raw[r or "", str(c)].append(v)
        per_row[r or ""].append(v)
        per_column[str(c)].append(v)
        if str(c) not in order:
            order.append(str(c))
    total = lambda v: aggregates(v)[0]
    ratio = lambda a, b: None if a is None or not b else a / b
    want = {}
    for r in per_row:
        before, run = None, None
        for c in order:
            v = total(raw[r, c]) if (r, c) in raw else None
            if show is S.DIFFERENCE:
                shown = None if v is None or before is None else v - before
            elif show is S.PERCENT_DIFFERENCE:
                shown = None if v is None or before is None else ratio(v - before, before)
            elif show is S.RUNNING_TOTAL:
                run = v if run is None else run + (v or 0)
                shown = run
            else:
                shown = ratio(v, total(per_row[r]) if show is S.PERCENT_OF_ROW else total(per_column[c]))
            if (r, c) in raw or show is S.RUNNING_TOTAL and shown is not None:
                want[r, c] = shown
            before = before if v is None else v
    found = {(x["r0"], x["c0"]): x["v0"] for x in got.labelled_cells().collect()}
    assert set(found) == set(want)
    for k, v in want.items():
        assert (found[k] is None) == (v is None) and (v is None or float(found[k]) == pytest.approx(float(Decimal(v) if isinstance(v, int) else v)))
    got.release()
