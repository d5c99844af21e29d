"""Golden values of the cleaners, a mutation for each family of rules, and the catalogue against its SQL."""

import datetime as dt
import os
from collections import Counter
from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

from billmill.functions import cleaning as C
from billmill.operators import accrual, documents, matching, rules
from billmill.plans import catalogue
from billmill.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(spark, column, cases, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    got = values(spark, C.amount, ["58,46,893.00", "(1,234.00)", "(-)0.46", "Rs.500", "Rs. 500", "₹ 12", "", None, "-", "abc", "1.2.3", "12-34"])
    assert got == [D("5846893"), D("-1234"), D("-0.46"), D(500), D("0.5"), D(12), None, None, None, None, None, D(1234)]


def test_dates(spark):
    got = values(spark, C.date, ["2026-06-01", "2026-12-05", "03/04/2026", "1-Jun-26", "21-JUL-26 6:31 PM", "2026-13-45", "", None])
    assert got == [dt.date(2026, 6, 1), dt.date(2026, 12, 5), dt.date(2026, 4, 3), dt.date(2026, 6, 1), dt.date(2026, 7, 21), None, None, None]


def test_identifiers(spark):
    assert values(spark, lambda c: C.gstin_problems(C.alnum_upper(c)), ["27NGACL2841M1ZO", "29SNRTB4426N2ZQ", "27ngacl2841m1zb", "27N", None]) == [[], [], ["checksum"], ["length"], []]
    assert values(spark, C.hsn, ["0802.1200", "8021200", "08", None]) == ["08021200", "08021200", "08", None]
    assert values(spark, C.unit, ["kgs.", "Quintal", "loads of things", "5"]) == ["KGS", "QTL", "LOADSOFTHING", None]
    assert values(spark, C.name_key, ["The Riverstone Impex Private Limited B-12", "RIVERSTONE IMPEX PVT LTD B 12", None]) == ["riverstone b 12"] * 2 + [""]
    assert values(spark, C.name_light, ["A&B Trdrs, Pvt. Ltd."]) == ["a and b traders private limited"]


def test_numbers(spark):
    assert values(spark, C.indian, [D("5846893"), D("915216"), D("0.34"), D("-1234.5"), D("12345678")], "decimal(18,2)") == ["58,46,893.00", "9,15,216.00", "0.34", "-1,234.50", "1,23,45,678.00"]
    got = values(spark, C.words_value, ["Sixty One Lakh Thirty Nine Thousand Two Hundred Thirty Eight", "Eight Lakh Eighty Four Thousand Four Hundred Sixty Three", "Nine lakhs Fifteen Thousand Two Hundred Sixteen", "nothing", None])
    assert got == [6139238, 884463, 915216, None, None]


BILL = "id long, invoice_number string, invoice_date date, due_date date, seller_id long, buyer_id long, n_lines long, lines_sum decimal(18,2), discounts decimal(18,2), additions decimal(18,2), charge_round decimal(18,2), charge_tcs decimal(18,2), taxable_value decimal(18,2), cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2), cess_amount decimal(18,2), tcs_amount decimal(18,2), round_off decimal(18,2), other_charges decimal(18,2), grand_total decimal(18,2), lines_quantity decimal(18,3), total_quantity decimal(18,3), amount_in_words string, seller_state string, buyer_state string, consignee_state string, seller_gstin string, buyer_gstin string"
GOOD = dict(zip([c.split()[0] for c in BILL.split(", ")], [1, "NGA/001634/26-27", dt.date(2026, 7, 21), dt.date(2026, 7, 28), 1, 2, 3, D("5846893"), None, None, D("0.34"), None, D("5846893"), D("146172.33"), D("146172.33"), None, None, None, None, None, D("6139238"), D(8750), D(8750), "Sixty One Lakh Thirty Nine Thousand Two Hundred Thirty Eight", "27", "27", None, "27NGACL2841M1ZO", "27RVSTL7392R1ZI"], strict=True))


@pytest.mark.parametrize("change, expected", [
    ({}, set()),
    ({"grand_total": D("613923.80")}, {"amount_in_words_mismatch", "grand_total_mismatch"}),
    ({"lines_sum": D("5756893")}, {"taxable_value_mismatch"}),
    ({"igst_amount": D("292344.66"), "cgst_amount": None, "sgst_amount": None}, {"supply_type_mismatch"}),
    ({"seller_gstin": "27NGACL2841M1ZB"}, {"gstin_invalid"}),
    ({"seller_state": "29"}, {"state_code_mismatch", "supply_type_mismatch"}),
    ({"total_quantity": D(8751)}, {"quantity_mismatch"}),
    ({"due_date": dt.date(2026, 7, 1)}, {"due_before_invoice"}),
    ({"invoice_date": dt.date(2027, 7, 21), "due_date": None}, {"date_in_future"}),
    ({"round_off": D(1)}, {"round_off_out_of_range"}),
    ({"invoice_number": None, "invoice_date": None, "grand_total": None, "n_lines": 0}, {"missing_required_field", "no_line_items"}),
])
def test_mutations(spark, change, expected):
    df = spark.createDataFrame([tuple({**GOOD, **change}.values())], BILL).withColumns({"irn": F.lit(None).cast("string"), "eway_bill_no": F.lit(None).cast("string")})
    found = [rules.required(df), rules.totals(df), rules.words(df), rules.supply(df), rules.formats(df, "2026-08-01"), rules.identities(df)]
    assert {r.rule for f in found for r in f.collect()} == expected


def test_brokerage_of_the_golden_bills(spark):
    rows = [(1, D("5846893.00")), (2, D("840845.25")), (3, D("871633.95"))]
    bills = spark.createDataFrame([(i, 1, 2, dt.date(2026, 7, 21), t, t, D(1), "2026-27") for i, t in rows], "id long, seller_id long, buyer_id long, invoice_date date, taxable_value decimal(18,2), grand_total decimal(18,2), total_quantity decimal(18,3), financial_year string")
    none = catalogue.rule_table(spark).limit(0)
    lines = spark.createDataFrame([], "invoice_id long, product_id long")
    assert {r.invoice_id: r.amount for r in accrual.accrued(bills, none, lines).collect()} == {1: D("58468.93"), 2: D("8408.45"), 3: D("8716.34")}


def test_rules_without_broadcast(spark, monkeypatch):
    want = Counter(map(tuple, catalogue.entries(spark, SF).collect()))
    monkeypatch.setattr(accrual, "BROADCAST_RULES", 1)
    assert Counter(map(tuple, catalogue.entries(spark, SF).collect())) == want


def test_ratios():
    assert round(matching.ratio("saun", "shaan"), 1) == 66.7 and round(matching.ratio("shaan", "ashapura"), 1) == 61.5
    assert matching.ratio("", "") == 100 and matching.token_set_ratio("a b", "b a c") == 100 and matching.token_set_ratio("", "a") == 0


def test_rows_and_payloads(spark):
    df = spark.createDataFrame([("IGST 5%", "", "1"), ("Grand Total", "", "1"), ("Hamali", "", "1"), ("", "", "1"), ("Mandi", "", "1"), ("Almond", "5", "1"), ("Discount slab", "2", "1")], "t string, q string, a string")
    assert [r.c for r in df.select(documents.row_class(F.col("t"), F.col("q"), F.col("a")).alias("c")).collect()] == ["tax", "total", "charge:labour", "total", "charge:other", "goods", "goods"]
    assert values(spark, documents.reconciled, [[1.0, 100.0, 100.5], [5.0, None, 9.0], []], "array<double>") == [100.0, 5.0, None]


def test_jobs(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True, 0), (2, "x", True, 0), (3, "x", True, 2), (4, "x", False, 0)], "id int, error string, retryable boolean, attempts int")
    assert {r.id: r.status for r in jobs.outcomes(df).collect()} == {1: "done", 2: "queued", 3: "failed", 4: "failed"}
    old = spark.createDataFrame([("a", "confirmed", 1), ("b", "extracted", 1)], "sha256 string, status string, v int")
    new = spark.createDataFrame([("a", "extracted", 2), ("b", "extracted", 2), ("c", "extracted", 2)], old.schema)
    assert {r.sha256: r.v for r in jobs.latest(old, new).collect()} == {"a": 1, "b": 2, "c": 2}


def test_ingest_drops_copies(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", b"one", dt.datetime(2026, 1, 1)), ("b.pdf", b"one", dt.datetime(2026, 1, 1)), ("c.pdf", b"two", dt.datetime(2026, 1, 2))], "filename string, content binary, arrived timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    jobs.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 2 and all(r.path.startswith("files/") for r in out)


def test_catalogue_against_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    show = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    for name in ("rollup_by_seller", "product_report", "summary_fy", "timeline", "brokerage_accrual", "search_invoices", "flags_totals", "clean_amounts", "page_quality"):
        found = con.execute(catalogue.ORACLES[name])
        columns = [c[0] for c in found.description]
        want = Counter(tuple(map(show, r)) for r in found.fetchall())
        assert Counter(tuple(map(show, r)) for r in catalogue.QUERIES[name](spark, SF).select(columns).collect()) == want, name


def test_entry_imports_without_the_text_operators():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['billmill.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
