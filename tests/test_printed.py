"""Golden values of what is printed on bills."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from billmill.functions import cleaning as C
from billmill.functions import printed as P


def values(spark, column, cases, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_figures(spark):
    assert values(spark, P.figure, ["4,500.000", "(-)1.5", "-2", "(3)", "1.2.3", "KGS", "", None, "₹ 12"]) == [D("4500"), D("-1.5"), D(-2), D(-3), None, None, None, None, D(12)]
    assert values(spark, C.percent, ["2.5 %", "%", None]) == [D("2.5"), None, None]
    assert [tuple(q) for q in values(spark, P.quantity, ["4,500.000 KGS", "kgs 12", "12", "bags", "", "B2 bags"])] == [(4500, "KGS"), (12, "KGS"), (12, None), (None, "BAGS"), (None, None), (2, "BAGS")]


def test_kinds_and_brokers(spark):
    assert values(spark, P.document_type, ["a\nCredit Note\n", "x\n" * 6 + "credit note", "Bill of Supply", "", None]) == ["credit_note", "tax_invoice", "bill_of_supply", "tax_invoice", "tax_invoice"]
    assert values(spark, P.broker, ["NILESH BHAI 0.5%", "Nileshbhai C38", " A  B %", ". -", "", None, "5%"]) == ["NILESH BHAI", "Nileshbhai C38", "A B", None, None, None, None]


def test_identifiers(spark):
    text = "GSTIN 27NGACL2841M1ZO and 27NGACL2841M1ZB, a.b@c.in, HDFC0001234, 400001 "
    assert values(spark, lambda c: P.found(c, "gstin"), [text, "", None]) == [["27NGACL2841M1ZO"], [], None]
    assert [values(spark, lambda c, k=k: P.found(c, k), [text])[0] for k in ("email", "ifsc", "pin")] == [["a.b@c.in"], ["HDFC0001234"], ["400001"]]
    assert values(spark, P.reference_number, ["a" * 64, "a" * 40 + "\n" + "b" * 24, "a" * 40, None]) == ["a" * 64, "a" * 40 + "b" * 24, None, None]
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a"])], "x array<string>, y array<string>")
    assert [r.z for r in df.select(P.remaining(F.col("x"), F.col("y")).alias("z")).collect()] == ["b", None]


def test_forms(spark):
    assert values(spark, P.number_forms, [D("5846893"), D("1234.505"), D("-12"), None], "decimal(18,3)") == [
        ["58,46,893.00", "5,846,893.00", "5846893.00", "5846893.000", "58,46,893", "5,846,893", "5846893"], ["1,234.50", "1234.50", "1234.505"], ["-12.00", "-12.000", "-12"], [],
    ]
    forms = values(spark, P.date_forms, [dt.date(2026, 7, 21), None], "date")
    assert {"21-Jul-26", "21/07/2026", "2026-07-21"} <= set(forms[0]) and len(forms[0]) == 8 and forms[1] == []


def test_settled(spark):
    one = spark.range(1)
    say = lambda f, a, b, k=None: tuple(one.select(P.settled(f, F.lit(a), F.lit(b), F.lit(k)).alias("x")).first().x)
    assert say("goods", "Cashew", "Kaju", True) == ("Cashew", "rules", None) and say("goods", "kaaju", "Cashew", False) == ("Cashew", "model", None)
    assert say("seller", "C31", "C13") == ("C31", "rules", None) and say("quantity", "5", "6") == ("5", "rules", "6") and say("quantity", "5", "5") == ("5", "rules", None)
    assert P.cost({}, F.lit("x"), F.lit(1), F.lit(1), F.lit(False)) is not None
