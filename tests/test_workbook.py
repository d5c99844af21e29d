"""Workbooks: what is written is what is read."""

import datetime as dt
from decimal import Decimal as D

import pandas as pd

from billmill.sources import workbook


def test_sheets_go_on():
    t = pd.DataFrame({"a": [1, 2, 3, 4, 5], "a long name of a column that is wider than any": ["x", None, "<&>\x00", " s ", ""]}, dtype=object)
    got = workbook.read(workbook.workbook({"One": t, "None": t.iloc[:0]}, most=3))
    assert list(got) == ["One", "One (2)", "One (3)", "None"] and [len(v) for v in got.values()] == [3, 3, 2, 1]
    assert [r[1] for n in list(got)[:3] for r in got[n][1:]] == ["x", None, "<&>", " s ", ""]


def test_round_trip(spark):
    bills = spark.createDataFrame([(i, f"N{i}", D(i) / 4, None if i % 2 else dt.date(2026, 1, 1)) for i in range(30)], "id long, number string, total decimal(18,2), day date")
    lines = spark.createDataFrame([(i % 30, i, "x" if i % 3 else None) for i in range(90)], "invoice_id long, line_no int, what string")
    books = workbook.workbooks(bills, lines, "invoice_id", bills_a_file=10)
    assert 1 < books.count() <= 3
    got = workbook.rows(books, "Invoices", "id string, number string, total string, day string").collect()
    assert sorted(map(tuple, got)) == sorted((str(i), f"N{i}", str((D(i) / 4).quantize(D("0.01"))), None if i % 2 else "2026-01-01") for i in range(30))
    assert workbook.rows(books, "Line Items", "invoice_id string, line_no string, what string").count() == 90
    assert workbook.workbooks(bills.limit(0), lines.limit(0), "invoice_id").count() == 0
