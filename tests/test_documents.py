"""Arrival, edits, filled blanks and scores of bills; words of pages; deals said in a sentence."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from billmill.operators import layout, lifecycle, sentences

LEX = sentences.Lexicon()


@pytest.mark.parametrize("said, deal", [
    ("C31 se V07 ko pachas bori walnut aath sau tera mein", ("C31", "V07", "Walnut", 50, "BAGS", 813)),
    ("from Micron to Virat Agro thirty-three bags kaju rate twelve fifty", ("Micron", "Virat Agro", "Cashew", 33, "BAGS", 1250)),
    ("Micron to Virat 1020 kg badam 793", ("Micron", "Virat", "Almond", 1020, "KGS", 793)),
    ("arre suno, Nilesh Ganpule Virat Agro do sau quintal haldi nau hazaar chaar sau", ("Nilesh Ganpule", "Virat Agro", "Turmeric", 200, "QTL", 9400)),
    ("C31-V07 50 boree walnut 8 13", ("C31", "V07", "Walnut", 50, "BAGS", 813)),
    ("C 31 to V 07 300 kg almond at 7.93", ("C31", "V07", "Almond", 300, "KGS", 793)),
    ("to Tv Rat 1020 kg", (None, "Tv Rat", None, 1020, "KGS", None)),
    ("note it down, Micron to Virat, 33 bags cashew 1,250", ("Micron", "Virat", "Cashew", 33, "BAGS", 1250)),
    ("three hundred kilo almond seven hundred ninety three rupees", (None, None, "Almond", 300, "KGS", 793)),
    ("haan ji theek hai", (None,) * 6), ("", (None,) * 6), (None, (None,) * 6), (" , . ₹ ", (None,) * 6),
])
def test_sentences(said, deal):
    got = sentences.read(said, LEX)
    assert tuple(got[f] for f in ("seller", "buyer", "goods", "quantity", "uom", "rate")) == deal


def test_long_sentences_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "C31 to V07 5 bags fig " + "word " * 5000, "mine"), (1, None, None), (1, None, None)], "id int, text string, rate string")
    rows = sentences.deals(df).collect()
    assert len(rows) == 3 and {r.seller for r in rows} == {"C31", None} and sentences.deals(df.limit(0)).count() == 0


def test_arrivals(spark):
    df = spark.createDataFrame([(2, "b.PDF", b"one"), (1, "a.pdf", b"one"), (3, "c.txt", b"one"), (4, "d.png", b""), (5, "e.png", None), (6, "f.jpg", b"x" * 99), (0, "g.txt", b"one"), (7, "nothing", b"two")], "id int, filename string, content binary")
    got = {r.id: (r.outcome, r.path) for r in lifecycle.arrivals(df, 50).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "bad_suffix", 1: "stored", 2: "duplicate", 3: "bad_suffix", 4: "empty", 5: "empty", 6: "too_large", 7: "bad_suffix"}
    assert got[1][1].endswith(".pdf") and got[1][1].startswith("files/76/92/") and got[2][1] is None


def test_edits(spark):
    bills = spark.createDataFrame([(1, "A", D("1.00"), dt.date(2026, 1, 1)), (2, "B", None, None), (3, "C", None, None)], "id int, number string, total decimal(18,2), day date")
    asked = spark.createDataFrame([(1, "number", "A"), (1, "total", "2.50"), (2, "day", "2026-02-03"), (2, "number", None), (3, "id", "9")], "id int, field string, value string")
    after, log = lifecycle.edited(bills, asked, ["number", "total", "day"])
    assert sorted(map(tuple, after.collect())) == [(1, "A", D("2.50"), dt.date(2026, 1, 1)), (2, None, None, dt.date(2026, 2, 3)), (3, "C", None, None)]
    assert sorted(tuple(r)[:2] for r in log.collect()) == [(1, "total"), (2, "day"), (2, "number")]


def test_totals_gate_and_scores(spark):
    bills = spark.createDataFrame([(1, None, D(5), None), (2, D(7), None, "PCS"), (3, None, None, None)], "id int, taxable_value decimal(18,2), total_quantity decimal(18,3), uom string")
    lines = spark.createDataFrame([(1, D(10), D(1), "KGS"), (1, D(20), D(2), None), (2, D(1), D(4), "BAG"), (2, D(1), D(4), "KGS")], "invoice_id int, taxable_amount decimal(18,2), quantity decimal(18,3), uom string")
    assert sorted(map(tuple, lifecycle.filled(bills, lines).collect())) == [(1, D(30), D(5), "KGS"), (2, D(7), D(8), "PCS"), (3, None, None, None)]
    flags = spark.createDataFrame([(1, "error", False), (2, "error", True), (3, "warning", False)], "invoice_id int, severity string, resolved boolean")
    assert dict(map(tuple, lifecycle.confirmable(bills, flags).collect())) == {1: False, 2: True, 3: True}
    assert dict(map(tuple, lifecycle.confirmable(bills, flags, F.col("id") == 1).collect()))[1]
    charges = spark.createDataFrame([(1, "discount", D(5)), (1, "discount", D(-3)), (1, "tds", D(1)), (1, "freight", D(2)), (1, None, D(9))], "invoice_id int, kind string, amount decimal(18,2)")
    assert tuple(lifecycle.charge_totals(charges).first())[:4] == (1, D(-8), D(0), D(1))
    truth = spark.createDataFrame([(1, D(100), "A & B"), (2, None, None)], "id int, m decimal(18,2), t string")
    read = spark.createDataFrame([(1, D(101), "ab")], "id int, m decimal(18,2), t string")
    assert {r.field: (r.hits, r.total) for r in lifecycle.scores(truth, read, {"m": "money", "t": "text"}).collect()} == {"m": (2, 2), "t": (2, 2)}


def test_nested_rows_and_pages(spark):
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, 'a"'), (2, 1, None)], "bill int, n int, what string")
    assert sorted(map(tuple, lifecycle.unnested(lifecycle.nested(lines, "bill", "n", ["what"]), "bill", "n int, what string").where("what is not null").collect())) == [(1, 1, 'a"'), (1, 2, "b")]
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (1, 3, " \n"), (2, 1, None)], "doc int, n int, text string")
    assert [tuple(r) for r in lifecycle.page_texts(pages, "doc", "n", "text").collect()] == [(1, "--- page 1 ---\none\n\n--- page 2 ---\ntwo")]


def test_lines_follow_their_mean(spark):
    words = spark.createDataFrame([(1, 1, x, x + 10.0, y, t) for x, y, t in [(0.0, 10.0, "a"), (12.0, 13.0, "b"), (60.0, 14.5, "c"), (0.0, 16.5, "d"), (0.0, 30.0, "e")]] + [(1, 2, 0.0, 1.0, 5.0, "f")], "doc int, page int, x0 double, x1 double, y double, text string")
    placed = layout.lines(words)
    assert {r.text: r.line for r in placed.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 2, "f": 0}
    cells = layout.cells(placed)
    assert {(r.page, r.line, r.cell): r.text for r in cells.collect()} == {(1, 0, 0): "a b", (1, 0, 1): "c", (1, 1, 0): "d", (1, 2, 0): "e", (2, 0, 0): "f"}
    heads = spark.createDataFrame([(1, 1, "left", 0.0, 20.0), (1, 1, "right", 50.0, 70.0)], "doc int, page int, name string, x0 double, x1 double")
    assert {r.text: r.column for r in layout.in_columns(cells, heads).collect()} == {"a b": "left", "c": "right", "d": "left", "e": "left", "f": None}
    assert layout.cells(layout.lines(words.limit(0))).count() == 0
