"""Goods tables, totals, tax tables and totals in words out of positioned words, on synthetic pages."""

import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from billmill.operators import labels, layout, matching, tables

SCHEMA = "doc int, page int, x0 double, x1 double, y double, text string"
PAGE = [
    (10, [(0, "TAX"), (30, "INVOICE")]),
    (30, [(0, "Sl"), (30, "Description"), (70, "of"), (80, "Goods"), (150, "HSN/SAC"), (200, "Alt."), (220, "Quantity"), (260, "Quantity"), (310, "Rate"), (340, "per"), (380, "Amount")]),
    (40, [(0, "No.")]),
    (60, [(0, "1ALMONDS"), (50, "KERNEL"), (150, "08021200"), (205, "34"), (225, "bags"), (260, "1,020.0"), (285, "KGS"), (310, "793.00"), (340, "KGS"), (380, "8,08,860.00")]),
    (70, [(30, "34"), (45, "Bags")]),
    (80, [(30, "Andesfood")]),
    (90, [(30, "Lot"), (45, "7")]),
    (110, [(30, "2"), (40, "Walnuts"), (260, "30"), (270, "bags"), (205, "990"), (220, "KGS"), (310, "893.00"), (380, "100.00")]),
    (130, [(30, "Less"), (60, ":"), (70, "ROUND"), (150, "OFF"), (380, "(-)0.46")]),
    (150, [(30, "Output"), (60, "CGST"), (310, "2.5"), (340, "%"), (380, "10.00")]),
    (170, [(30, "Total"), (380, "8,08,969.54")]),
    (190, [(0, "Tot.Taxable"), (50, "Amt"), (70, ":"), (75, "58,46,893.00"), (150, "Other"), (180, "Amt"), (200, ":"), (205, "0.34"), (250, "Total"), (280, "Inv"), (300, "Amt"), (320, ":"), (330, "61,39,238.00")]),
    (210, [(0, "Amount"), (40, "Chargeable"), (90, "(in"), (110, "words)")]),
    (230, [(0, "Sixty"), (40, "One"), (60, "Lakh"), (85, "Rupees"), (200, "Previous"), (250, "Balance")]),
    (250, [(0, "Thirty"), (40, "Nine"), (60, "Only")]),
    (270, [(0, "HSN/SAC"), (60, "Taxable"), (100, "CGST"), (150, "SGST"), (200, "Total")]),
    (290, [(0, "080212"), (60, "5,000.00"), (100, "2.5"), (120, "125.00"), (150, "2.5"), (170, "125.00"), (200, "250.00")]),
    (310, [(0, "0802"), (60, "1.00")]),
    (330, [(0, "IGST"), (40, "5"), (50, "%"), (60, "1,78,152.38")]),
]


def words(doc, page, lines):
    return [(doc, page, float(x), x + 4.5 * len(t) if len(t) > 1 else x + 4.0, float(y), t) for y, ws in lines for x, t in ws]


def lined(spark, *pages):
    return tables.by_line(layout.lines(spark.createDataFrame([w for p in pages for w in words(*p)], SCHEMA)))


def test_goods_table(spark):
    eway = [(5, [(0, "e-Way"), (30, "Bill")]), *PAGE[1:5]]
    lines = tables.without_annexures(lined(spark, (1, 1, PAGE), (1, 2, eway), (2, 1, PAGE[:1])))
    heads = tables.headings(lines).collect()
    assert [(h.doc, h.page, h.line, h.last) for h in heads] == [(1, 1, 1, 2)]
    assert [c.name for c in heads[0].columns] == ["serial", "description", "hsn", "bags", "quantity", "rate", "rate_uom", "amount"]
    table = tables.rows(lines, tables.headings(lines))
    got = {r.row: r for r in table.collect()}
    assert {k: r["class"] for k, r in got.items()} == {1: "goods", 2: "goods", 3: "charge:round_off", 4: "tax"}
    assert (got[1].serial, got[1].description, got[1].hsn, got[1].bags, got[1].quantity, got[1].rate, got[1].rate_uom, got[1].amount) == ("1", "ALMONDS KERNEL", "08021200", "34 bags", "1,020.0 KGS", "793.00", "KGS", "8,08,860.00")
    assert got[1].extra == ["34 Bags", "Andesfood", "Lot 7"]
    assert (got[2].serial, got[2].description, got[2].quantity, got[2].bags) == ("2", "Walnuts", "990 KGS", "30 bags")
    below = table.select("row", tables.beneath(F.col("description"), F.col("item_remarks"), F.col("extra")).alias("b")).select("row", "b.*")
    assert {r.row: tuple(r)[1:] for r in below.where("row < 3").collect()} == {1: ("ALMONDS KERNEL Lot 7", 34.0, "Andesfood"), 2: ("Walnuts", None, None)}


def test_many_rows_stay(spark):
    goods = [(60 + 10 * i, [(0, str(i)), (260, "1"), (380, "5.00")]) for i in range(500)]
    lines = lined(spark, (1, 1, PAGE[1:2] + goods))
    assert tables.rows(lines, tables.headings(lines)).where("class = 'goods'").count() == 500


def test_totals(spark):
    lines = lined(spark, (1, 1, PAGE))
    got = {r.field: r.value for r in tables.totals(lines).collect()}
    assert got == {"taxable_value": D("5846893"), "cgst_amount": D("10"), "grand_total": D("6139238"), "igst_amount": D("178152.38"), "round_off": D("-0.46")}
    far = lines.select("doc", "page", F.lit(300.0).alias("y")).distinct()
    assert [r.field for r in tables.totals(lines, far).collect()] == ["igst_amount"]


def test_total_in_words(spark):
    one_line = [(10, [(0, "Tax"), (20, "Amount"), (60, "(in"), (80, "words)"), (120, "Two"), (140, "Hundred"), (180, "Only")]), (30, [(0, "Amount"), (40, "in"), (50, "words"), (80, ":"), (90, "Nine"), (120, "lakhs"), (150, "Fifteen")])]
    got = dict(map(tuple, tables.in_words(lined(spark, (1, 1, PAGE), (2, 1, one_line), (3, 1, PAGE[:2]))).collect()))
    assert got == {1: "Sixty One Lakh Rupees Thirty Nine Only", 2: "Nine lakhs Fifteen"}


def test_tax_table(spark):
    got = tables.tax_rows(lined(spark, (1, 1, PAGE), (2, 1, PAGE[16:]))).collect()
    assert [(r.doc, r.hsn, r.taxable_value, r.total_tax) for r in got] == [(1, "080212", D(5000), D(250))]
    assert [tuple(t) for t in got[0].taxes] == [("cgst", D("2.5"), D(125)), ("sgst", D("2.5"), D(125))]


def test_nothing(spark):
    lines = tables.by_line(layout.lines(spark.createDataFrame([], SCHEMA)))
    assert tables.rows(lines, tables.headings(lines)).count() == tables.totals(lines).count() == tables.in_words(lines).count() == tables.tax_rows(lines).count() == 0
    blank = lined(spark, (1, 1, [(10, [(0, "")])]))
    assert tables.headings(blank).count() == tables.tax_rows(blank).count() == 0


HEADER = [
    (10, [(0, "Invoice"), (30, "No."), (100, "e-Way"), (130, "Bill"), (150, "No."), (250, "Dated")]),
    (22, [(0, "14593"), (30, "/"), (36, "2026-27"), (100, "181234567890"), (250, "24-Jul-26")]),
    (40, [(0, "Broker"), (35, "Name"), (60, ":"), (64, "NILESH"), (100, "BHAI"), (200, "Destination"), (256, ":"), (262, "Pune"), (400, "far")]),
    (60, [(0, "Transporter"), (50, "Name")]),
    (72, [(0, "4."), (10, "Transportation"), (80, "Details")]),
    (90, [(0, "Broker"), (60, "SURESH")]),
]


def test_labels(spark):
    lines = lined(spark, (1, 1, HEADER), (2, 1, HEADER[3:]), (3, 1, []))
    fields = {"number": ("invoice no", "bill no"), "eway": ("e-way bill no",), "date": ("dated",), "broker": ("broker name", "broker"), "agent": ("broker",), "to": ("destination",), "carrier": ("transporter name",)}
    got = {(r.doc, r.field): r.value for r in labels.values(lines, fields).collect()}
    assert got == {(1, "number"): "14593 / 2026-27", (1, "eway"): "181234567890", (1, "date"): "24-Jul-26", (1, "broker"): "NILESH BHAI", (1, "to"): "Pune", (1, "agent"): "SURESH", (2, "broker"): "SURESH", (2, "agent"): "SURESH"}
    assert {(r.doc, r.field, r.value) for r in labels.extras(lines).collect()} == {(1, "Destination", "Pune")}
    captured = spark.createDataFrame([(1, "a broker")], "doc int, field string")
    assert {tuple(r) for r in labels.gaps(lines, captured).collect()} == {(2, "a broker")}
    assert labels.values(lines.limit(0), fields).count() == 0


def nearest(heard, known):
    """By comparing with each known name: the close and clear one, or what was heard."""
    norm = lambda t: "".join(c for c in t.lower() if c.isascii() and c.isalnum())
    if len(norm(heard)) < 3:
        return heard
    scored = sorted(((matching.ratio(norm(heard), norm(k)), k) for k in known if norm(k)), reverse=True)
    if scored and (norm(scored[0][1]) == norm(heard) or scored[0][0] >= 65 and (len(scored) < 2 or scored[0][0] - scored[1][0] >= 6)):
        return scored[0][1]
    return heard


def test_snapping(spark):
    known = ["Ashapura", "Shaan", "काजू Traders", "Virat Agro", "Micron", "Nilesh Ganpule", "Cashew Mart", "Cashew Mars", None, "Ab"]
    heard = ["virat agr", "Asapura", "Zephyrix", "traderz", "काजू", "Maikron", "nilesh ganpuley", "cashew ma", "CASHEW MART", "entirely unknown", "", None, "ab", "virat agr", "x" * 3000]
    names = spark.createDataFrame([(k,) for k in known], "name string")
    got = matching.snapped(spark.createDataFrame(list(enumerate(heard)), "ask_id int, heard string"), names)
    want = {i: h if h is None else nearest(h, [k for k in known if k]) for i, h in enumerate(heard)}
    assert {r.ask_id: r.name for r in got.collect()} == want and want[0] == "Virat Agro" and want[7] == "cashew ma" and want[1] == "Ashapura" and want[2] == "Zephyrix"
    assert [r.name for r in matching.snapped(spark.createDataFrame([(1, "abc")], "ask_id int, heard string"), names.limit(0)).collect()] == ["abc"]


def test_fuzzy_loses_no_pair(spark):
    from billmill.functions.cleaning import name_key, name_light
    from billmill.plans.catalogue import QUERIES

    known = [(1, "lcdfe46", "27"), (2, "Riverstone Impex", "27"), (3, "Nilesh Ganpule", None), (4, "sunrise dryfruits", "24"), (5, "Shan Trading Co", "24"), (6, "sunrise dryfruits", "27"), (7, None, "27"), (8, "Pvt Ltd", "27"), (9, "gamma beta alphas", "24"), (10, "lcdfe46", "27")]
    asked = [(1, "lcdf e 46", "27"), (2, "riverstne", "27"), (3, "Nilesh Ganpule", "24"), (4, "sunrize dryfruit", "24"), (5, "sunrize dryfruit", None), (6, "Nilesh Ganpuley", None), (7, None, "27"), (8, "Pvt Ltd", "27"), (9, "alpha gamme bet", "24"), (10, "lcdf e 46", "24"), (1, "lcdf e 46", "27")]
    rnd = random.Random(8)
    for n in range(60):  # names of few letters, and the same with letters lost, doubled and moved
        name = "".join(rnd.choices("abc ", k=rnd.randrange(1, 26)))
        known.append((100 + n, name, rnd.choice(["27", "24", None])))
        for _ in range(3):
            near = list(name)
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(near) + 1)
                near[at : at + rnd.randrange(2)] = rnd.choices("abc ", k=rnd.randrange(2))
            asked.append((1000 + len(asked), "".join(near), rnd.choice(["27", "24", None])))
    a, k = spark.createDataFrame(asked, "ask_id long, name string, block string"), spark.createDataFrame(known, "party_id long, name string, block string")
    keyed = lambda df: [(*r,) for r in df.withColumns({"key": name_key("name"), "light": name_light("name")}).collect()]
    want = set()
    for i, _, b, key, light in keyed(a):
        found = [(-matching.closeness((key, light), (y, o)), p) for p, _, c, y, o in keyed(k) if key and y and (b is None or c is None or b == c)]
        if found and min(found)[0] <= -88:
            want.add((i, min(found)[1], -min(found)[0]))
    got = sorted(map(tuple, matching.fuzzy(a, k).collect()))
    assert got == sorted(want) and got[0] == (1, 1, 100.0) and {i for i, _, _ in got} >= {1, 3, 4, 5, 6}
    sf = "/root/testdata/sf0.001"
    assert QUERIES["resolve_fuzzy"](spark, sf).select("ask_id").distinct().count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_lines_of_pages_shuffle_words_once(spark):
    rnd = random.Random(5)
    rows = [(d, p, float(x), x + 9.0, rnd.choice([0, 2, 3.4, 7, 9, 30, 31]) * 1.0, rnd.choice(["a", "B", None])) for d in range(6) for p in (1, 2) for x in rnd.choices(range(60), k=rnd.randrange(1, 30))]
    words = spark.createDataFrame(rows, "doc int, page int, x0 double, x1 double, y double, text string")
    plain = lambda df: sorted((r.doc, r.page, r.line, round(r.y, 6), repr(r.w), r.text) for r in df.collect())
    assert plain(tables.page_by_line(words)) == plain(tables.by_line(layout.lines(words)))
    plan = tables.page_by_line(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("collect_list") == 2  # a partial and a final one


def test_labels_may_begin_with_what_does_not_count(spark):
    lines = spark.createDataFrame([(1, 1, 0, 0.0, [(0.0, 5.0, ":"), (6.0, 20.0, "Broker"), (21.0, 25.0, "Name."), (30.0, 60.0, "Ajay")], ": Broker Name. Ajay")], "doc int, page int, line long, y double, w array<struct<x0:double,x1:double,text:string>>, text string")
    assert [(r.field, r.value) for r in labels.values(lines, {"b": ("broker name",)}).collect()] == [("b", "Ajay")]
    found = tables.labelled(lines, {"broker": "b", "broker name": "b"}, lambda c: tables.tidy(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))).select("labels").first().labels
    assert [(x["at"], x["size"], x["name"]) for x in found] == [(0, 2, "b")]
