"""Workbooks with a sheet of bills and a sheet of their lines, as many files as the rows need, each made in one task."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that a sheet has room for, widths of columns, names and schemas of the format's parts.
ROWS, NARROW, WIDE, SPARE = 1_048_576, 12, 40, 6
MAIN, REL, PACKAGE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
STYLES = f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'

#: Bills in one workbook.
BILLS = 10_000


def cell(v: object, style: str = "") -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "<c/>"
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) and math.isfinite(v):
        return f"<c><v>{v}</v></c>"
    return f'<c{style} t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", str(v)))}</t></is></c>'


def sheet(columns: list[str], rows: Iterator[tuple]) -> Iterator[str]:
    """A sheet with a bold heading that stays in view."""
    widths = "".join(f'<col min="{i}" max="{i}" width="{max(NARROW, min(len(c) + SPARE, WIDE))}" customWidth="1"/>' for i, c in enumerate(columns, 1))
    yield f'<worksheet xmlns="{MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData><row>'
    yield "".join(cell(c, ' s="1"') for c in columns) + "</row>"
    for r in rows:
        yield f"<row>{''.join(map(cell, r))}</row>"
    yield "</sheetData></worksheet>"


def workbook(tables: dict[str, pd.DataFrame], most: int = ROWS) -> bytes:
    """The tables as sheets of one file; one with more rows than a sheet has room for goes on in a further sheet."""
    parts = [(f"{name} ({k + 1})" if k else name, t.iloc[k * (most - 1) : (k + 1) * (most - 1)]) for name, t in tables.items() for k in range(max(1, math.ceil(len(t) / (most - 1))))]
    out, numbers = io.BytesIO(), range(1, len(parts) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{KIND}.{k}+xml"/>' for p, k in [("workbook", "sheet.main"), ("styles", "styles"), *((f"worksheets/sheet{i}", "worksheet") for i in numbers)])
        z.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r0" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{"".join(f"""<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>""" for i, (n, _) in zip(numbers, parts))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r0" Type="{REL}/styles" Target="styles.xml"/>{"".join(f"""<Relationship Id="r{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in numbers)}</Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        for i, (_, t) in zip(numbers, parts):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                for text in sheet(list(t.columns), t.itertuples(index=False, name=None)):
                    f.write(text.encode())
    return out.getvalue()


def workbooks(bills: DataFrame, lines: DataFrame, bill: str, bills_a_file: int = BILLS) -> DataFrame:
    """(file, content): bills by their column id and lines by their column bill, in workbooks of about bills_a_file
    bills. How many there are follows from a count; a bill and its lines are in one file. Without rows, there is none."""
    files = max(1, math.ceil(bills.count() / bills_a_file))
    dealt = lambda df, key: df.groupBy(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(files)).alias("file"))
    of_bill, of_line = bills.columns, lines.columns

    def made(key: tuple, b: pd.DataFrame, ln: pd.DataFrame) -> pd.DataFrame:
        tables = {"Invoices": b[of_bill].sort_values("id"), "Line Items": ln[of_line].sort_values([bill, *of_line[:1]])}
        return pd.DataFrame({"file": [key[0]], "content": [workbook({n: t.astype(object).where(t.notna(), None) for n, t in tables.items()})]})

    return dealt(bills, "id").cogroup(dealt(lines, bill)).applyInPandas(made, "file long, content binary")


def read(content: bytes) -> dict[str, list[list[str | None]]]:
    """The cells of each sheet as text, headings first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")]
        text = lambda c: "".join(t.text or "" for t in c.iter() if t.tag in (f"{{{MAIN}}}v", f"{{{MAIN}}}t")) if len(c) else None
        return {n: [[text(c) for c in r] for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{MAIN}}}row")] for i, n in enumerate(names, 1)}


def rows(books: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows of one sheet, and of those that it goes on in, of all workbooks; schema names strings."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for n, (head, *body) in read(content).items():
                    if n == name or n.startswith(f"{name} ("):
                        yield pd.DataFrame(body, columns=head)

    return books.select("content").mapInPandas(cells, schema)
