"""Where results go: CSV and JSON by Spark's writers, wide tables, and small workbooks.

Workbooks are presentation: their rows come to the driver, and their size is checked first.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, functions as F

from crossloom.functions.display import Format, Rule, highlight
from crossloom.plans.engine import PivotFrames
from crossloom.plans.errors import PivotError

TOTAL = "Total"
# The characters that XML allows beside tab and line ends.
_NOT_XML = re.compile("[^\t\n\r%s-%s%s-%s%s-%s]" % tuple(map(chr, (0x20, 0xD7FF, 0xE000, 0xFFFD, 0x10000, 0x10FFFF))))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with a header; quotes are doubled."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def csv_text(df: DataFrame, most_rows: int = 20_000) -> str:
    """A small table as one text: byte-order mark, header, rows ended by line feeds, quotes only where needed."""
    rows = _few(df, most_rows)
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if re.search('[",\n]', v) else v
    lines = [df.columns, *(["" if v is None else str(v) for v in r] for r in rows)]
    return "\ufeff" + "\n".join(",".join(map(quoted, line)) for line in lines)


def tab_row(df: DataFrame, name: str = "copied") -> DataFrame:
    """Every row's values joined by tabs."""
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias(name))


def as_json(result: PivotFrames) -> dict[str, DataFrame]:
    """Each frame of a result as one column of JSON rows, for whatever carries them on."""
    frames = {k: getattr(result, k) for k in ("rows", "columns", "cells", "row_totals", "column_totals", "subtotals", "grand")}
    return {k: df.select(F.to_json(F.struct("*")).alias("json")) for k, df in frames.items() if df is not None}


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise PivotError(f"more than {most} rows to export")
    return rows


def wide(result: PivotFrames, measure: int = 0, most_columns: int = 1000) -> DataFrame:
    """The cross-tab itself: a row per row header in order, a column per column header, and the row total."""
    n = len(result.request.columns)
    heads = result.columns.orderBy("column_index").limit(most_columns + 1).collect()
    if len(heads) > most_columns:
        raise PivotError(f"more than {most_columns} columns to spread")
    v = f"v{measure}"
    spread = result.cells.groupBy("row_index").pivot("column_index", [h["column_index"] for h in heads]).agg(F.first(v))
    names = [" / ".join(h[f"c{i}"] for i in range(n)) if n else TOTAL for h in heads]
    names = [x if names.count(x) == 1 and x not in result.rows.columns else f"{x} ({i})" for i, x in enumerate(names)]
    spread = spread.select("row_index", *(F.col(f"`{h['column_index']}`").alias(x) for h, x in zip(heads, names)))
    return result.rows.join(spread, "row_index", "left").join(result.row_totals.select("row_index", F.col(v).alias("row total")), "row_index", "left")


@dataclass
class Cell:
    """text or number; spans; role: title, header, label, value, total; a number format and a fill colour."""

    value: str | float | None = None
    role: str = "value"
    columns: int = 1
    rows: int = 1
    number_format: str | None = None
    fill: str | None = None


@dataclass
class Document:
    title: str
    rows: list[list[Cell]]
    filters: str = ""
    sheet: str = "Pivot"
    frozen_rows: int = 1
    frozen_columns: int = 1
    widths: list[int] = field(default_factory=list)


def document(result: PivotFrames, title: str, formats: dict[str, Format] | None = None, rules: dict[str, list[Rule]] | None = None, filters: str = "", most_rows: int = 20_000, most_cells: int = 200_000) -> Document:
    """A result as a table of cells: header rows, a row per row header, row totals, and the grand-total row."""
    request, m, n = result.request, max(1, len(result.request.rows)), len(result.request.columns)
    columns = [r.asDict() for r in result.columns.orderBy("column_index").limit(most_cells + 1).collect()]
    measures = [(f"v{i}", v.key) for i, v in enumerate(request.values)]
    form = {k: (formats or {}).get(k, Format()).excel() for _, k in measures}
    colors = {k: highlight(F.col(v), (rules or {}).get(k, [])).alias(f"_{v}") for v, k in measures}
    rows = _few(result.rows.orderBy("row_index"), most_rows)
    if len(rows) * max(1, len(columns)) * len(measures) > most_cells:
        raise PivotError(f"more than {most_cells} cells to export")
    cells = {(r["row_index"], r["column_index"]): r for r in result.cells.select("*", *colors.values()).collect()}
    totals = {r["row_index"]: r for r in result.row_totals.collect()}
    bottom = {r["column_index"]: r for r in result.column_totals.collect()}
    grand = result.grand.first()
    body: list[list[Cell]] = []
    for level in range(n):
        line = [Cell(None, "header", m)]
        for c in columns:
            if line[1:] and all(c[f"c{i}"] == last[f"c{i}"] for i in range(level + 1)) and level < n - 1:
                line[-1].columns += len(measures)
            else:
                line.append(Cell(c[f"c{level}"] or "-", "header", len(measures)))
            last = c
        body.append([*line, Cell(TOTAL if level == 0 else None, "header", len(measures))])
    names = [Cell(f, "header") for f in request.rows] or [Cell(None, "header")]
    body.append([*names, *(Cell(k, "header") for _ in [*columns, None] for _, k in measures)])
    number = lambda r, v, k, role, fill=None: Cell(None if r is None or r[v] is None else float(r[v]), role, number_format=form[k], fill=fill)
    for r in rows:
        head = [Cell(r[f"r{i}"] or "-", "label") for i in range(len(request.rows))] or [Cell(TOTAL, "label")]
        own = [number(x := cells.get((r["row_index"], c["column_index"])), v, k, "value", x and x[f"_{v}"]) for c in columns for v, k in measures]
        body.append([*head, *own, *(number(totals.get(r["row_index"]), v, k, "total") for v, k in measures)])
    body.append([Cell(TOTAL, "total", m), *(number(bottom.get(c["column_index"]), v, k, "total") for c in columns for v, k in measures), *(number(grand, v, k, "total") for v, k in measures)])
    return Document(title, body, filters, frozen_rows=n + 1, frozen_columns=m)


def a1(row: int, column: int) -> str:
    """The name of a cell; rows and columns from 1."""
    name = ""
    while column:
        column, at = divmod(column - 1, 26)
        name = chr(65 + at) + name
    return f"{name}{row}"


def _clean(text: str) -> str:
    return escape(_NOT_XML.sub("", text))


def sheet_name(name: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", "", name)[:31].strip() or "Pivot"


def workbook(doc: Document) -> bytes:
    """An .xlsx file: title in row 1, filters in row 2, the table from row 4, spans merged, panes frozen."""
    styles: dict[tuple, int] = {("value", None, None): 0}
    style = lambda c: styles.setdefault((c.role, c.number_format, c.fill), len(styles))
    lines, merges, taken = [], [], set()
    lines.append(f'<row r="1">{_text(1, 1, doc.title, styles.setdefault(("title", None, None), len(styles)))}</row>')
    lines.append(f'<row r="2">{_text(2, 1, doc.filters, 0)}</row>')
    widest = 1
    for i, row in enumerate(doc.rows, 4):
        at, out = 1, []
        for cell in row:
            while (i, at) in taken:
                at += 1
            taken |= {(i + y, at + x) for y in range(cell.rows) for x in range(cell.columns)}
            if cell.rows * cell.columns > 1:
                merges.append(f"{a1(i, at)}:{a1(i + cell.rows - 1, at + cell.columns - 1)}")
            if isinstance(cell.value, (int, float)):
                out.append(f'<c r="{a1(i, at)}" s="{style(cell)}"><v>{cell.value!r}</v></c>')
            else:
                out.append(_text(i, at, cell.value or "", style(cell)))
            at += cell.columns
        widest = max(widest, at - 1)
        lines.append(f'<row r="{i}">{"".join(out)}</row>')
    top, left = 3 + doc.frozen_rows, doc.frozen_columns
    pane = f'<sheetViews><sheetView workbookViewId="0"><pane xSplit="{left}" ySplit="{top}" topLeftCell="{a1(top + 1, left + 1)}" activePane="bottomRight" state="frozen"/></sheetView></sheetViews>'
    chars = [min(60.0, max(8.0, (max(56, w) - 5) / 7)) for w in (doc.widths + [118] * widest)[:widest]]
    cols = "<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w:.2f}" customWidth="1"/>' for i, w in enumerate(chars, 1)) + "</cols>"
    merged = f'<mergeCells count="{len(merges)}">{"".join(f"<mergeCell ref={quoteattr(m)}/>" for m in merges)}</mergeCells>' if merges else ""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel, pkg = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet_name(doc.sheet))} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}">{pane}{cols}<sheetData>{"".join(lines)}</sheetData>{merged}</worksheet>',
        "xl/styles.xml": _styles(list(styles), main),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()


def _text(row: int, column: int, text: str, style: int) -> str:
    return f'<c r="{a1(row, column)}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_clean(text)}</t></is></c>'


def _styles(styles: list[tuple], main: str) -> str:
    forms = {f: 164 + i for i, f in enumerate(dict.fromkeys(f for _, f, _ in styles if f))}
    fills = {f: 2 + i for i, f in enumerate(dict.fromkeys(f for _, _, f in styles if f))}
    bold = ("title", "header", "total")
    xfs = "".join(f'<xf numFmtId="{forms.get(f, 0)}" fontId="{int(role in bold)}" fillId="{fills.get(fill, 0)}" borderId="0" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1"/>' for role, f, fill in styles)
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{f.lstrip("#").upper()}"/></patternFill></fill>' for f in fills)
    return (
        f'<styleSheet xmlns="{main}"><numFmts count="{len(forms)}">' + "".join(f"<numFmt numFmtId=\"{i}\" formatCode={quoteattr(f)}/>" for f, i in forms.items()) + "</numFmts>"
        '<fonts count="2"><font/><font><b/></font></fonts>'
        f'<fills count="{2 + len(fills)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="{len(styles)}">{xfs}</cellXfs></styleSheet>'
    )
