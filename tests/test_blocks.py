"""Party blocks and letterheads on synthetic pages."""

from billmill.operators import blocks

from .test_tables import lined

PAGE = [
    (10, [(0, "TAX"), (30, "INVOICE")]),
    (25, [(0, "Riverstone"), (60, "Impex"), (250, "Invoice"), (300, "No.")]),
    (40, [(0, "APMC"), (40, "Yard"), (250, "NGA/1634")]),
    (55, [(0, "GSTIN"), (40, ":"), (50, "27NGACL2841M1ZO")]),
    (80, [(0, "Buyer"), (40, "(Bill"), (70, "to)"), (250, "Consignee"), (320, "(Ship"), (350, "to)")]),
    (95, [(0, "Virat"), (40, "Agro"), (250, "Micron"), (300, "Foods")]),
    (110, [(0, "12"), (20, "Park"), (50, "Road"), (250, "Pune")]),
    (125, [(0, "GSTIN"), (40, "29SNRTB4426N2ZQ"), (250, "GSTIN"), (300, "27NGACL2841M1ZB")]),
    (140, [(0, "Buyer's"), (50, "PAN"), (80, "NO")]),
    (155, [(0, "Supplier")]),
    (170, [(0, "Riverstone")]),
]


def test_blocks(spark):
    lines = lined(spark, (1, 1, PAGE), (2, 1, PAGE[:1]), (3, 2, PAGE))
    got = {(r.doc, r.page, r.role): (r.name, r.gstin, r.lines) for r in blocks.parties(lines).collect()}
    want = {"buyer": ("Virat Agro", "29SNRTB4426N2ZQ", ["12 Park Road", "GSTIN 29SNRTB4426N2ZQ", "Buyer's PAN NO"]), "consignee": ("Micron Foods", None, ["Pune", "GSTIN 27NGACL2841M1ZB"]), "seller": ("Riverstone", None, [])}
    assert got == {(d, p, r): v for d, p in [(1, 1), (3, 2)] for r, v in want.items()}
    heads = {r.doc: (r.name, r.gstin, r.lines) for r in blocks.letterheads(lines).collect()}
    assert heads == {1: ("Riverstone Impex", "27NGACL2841M1ZO", ["TAX INVOICE", "APMC Yard", "GSTIN : 27NGACL2841M1ZO"]), 2: (None, None, ["TAX INVOICE"])}
    assert blocks.parties(lines.limit(0)).count() == blocks.letterheads(lines.limit(0)).count() == 0
