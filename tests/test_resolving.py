"""Parties, folders, dates, words and deals: cases that the registered queries don't have."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from billmill.functions import cleaning as C
from billmill.functions import printed
from billmill.operators import documents, exports, matching, reports, resolving, sentences, spoken

PARTY = "party_id long, legal_name string, display_name string, state_code string, gstin string"
ASK = "ask_id long, name string, gstin string, state_code string"


def values(spark, column, cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_exact_tiers_want_one_party(spark):
    parties = spark.createDataFrame([(1, "Shree Agro", "", "27", "27AAAAA0000A1Z5"), (2, "Shree Traders", "", "27", None), (3, "The Trading Company", "", "27", None), (4, "Om Mills", "", "24", None), (5, "Om Mills Ltd", "", "27", None)], PARTY)
    asked = spark.createDataFrame([(1, "Shree", None, "27"), (2, None, None, "27"), (3, "Company Ltd", None, "27"), (4, "Om Mills Co", None, "24"), (5, "x", "27-aaaaa-0000a1z5", None), (6, "Om Mills", None, "29")], ASK)
    got = {r.ask_id: (r.party_id, r.tier) for r in matching.exact_tiers(asked, parties, spark.createDataFrame([], "alias string, party_id long")).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (4, "by_state"), 5: (1, "by_gstin"), 6: (None, None)}


def test_numbers_that_differ_keep_firms_apart(spark):
    parties = spark.createDataFrame([(1, "Zenith Agro Private Limited", "", "27", "27AAAAA0000A1Z5")], PARTY)
    aliases = spark.createDataFrame([], "alias string, party_id long")
    asked = spark.createDataFrame([(1, "Zenith Agros Pvt Ltd", "29AAAAA0000A1Z5", None), (2, "Zenith Agros Pvt Ltd", None, None), (3, "Zenith Agro Pvt Ltd", "29AAAAA0000A1Z5", None)], ASK)
    assert {r.ask_id: r.party_id for r in resolving.found_parties(asked, parties, aliases).collect()} == {1: None, 2: 1, 3: 1}
    assert {r.ask_id: r.party_id for r in resolving.found_parties(asked, parties, aliases, strict=True).collect()} == {1: None, 2: 1, 3: None}


def test_folder_scan(spark, tmp_path):
    for name in ("a.pdf", "b.PNG", ".hidden.pdf", "c.txt", "sub/d.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    names = lambda deep: [(r.filename, bytes(r.content)) for r in exports.bill_files(spark, str(tmp_path), deep).collect()]
    assert names(False) == [("a.pdf", b"a.pdf"), ("b.PNG", b"b.PNG")]
    assert [n for n, _ in names(True)] == ["a.pdf", "b.PNG", "d.jpeg"]


def test_free_form_dates(spark):
    cases = ["21 July 2026", "July 21, 2026", "21-07-26", "Dated 21-Jul-26", "2026-06-01", "03/04/2026", "1-Jun-26", "21-Jul-26 6:31 PM", "2026-13-45", "", None, "07/21/2026", "21st of July, 2026", "12.05.99", "no date", "99/99/2026"]
    assert values(spark, C.date, cases) == [dt.date(2026, 7, 21)] * 4 + [dt.date(2026, 6, 1), dt.date(2026, 4, 3), dt.date(2026, 6, 1), dt.date(2026, 7, 21), None, None, None, dt.date(2026, 7, 21), dt.date(2026, 7, 21), dt.date(1999, 5, 12), None, None]


def test_amounts_in_words(spark):
    cases = ["Sixty One Lakh Thirty Nine Thousand Two Hundred Thirty Eight", "INR Rupees Nine Lakh Fifteen Thousand Two Hundred Sixteen Only", "Forty Four and Sixty Six paise Only", "Eighty-One Rupees and Seventy only", "Amount (in words) : Hundred", "nothing", None]
    assert values(spark, C.words_amount, cases) == [D("6139238.00"), D("915216.00"), D("44.66"), D("81.70"), D("100.00"), None, None]


def test_read_back(spark):
    df = spark.createDataFrame([("A", "B", "Cashew", D(10), "BAGS", D(1250)), (None, None, None, None, None, None), (None, "B", None, D("990.5"), "KGS", None), ("A", None, "Fig", None, None, D("816.02"))], "s string, b string, g string, q decimal(16,3), u string, r decimal(16,2)")
    got = [r.t for r in df.select(spoken.read_back(*(F.col(c) for c in "sbgqur")).alias("t")).collect()]
    assert got == ["A sold B 10 bags of Cashew at 1,250 per bag — 12,500.", None, "Sold to B 990.50 kg.", "A sold Fig at 816.02."]


def test_goods_and_scripts():
    lex = sentences.Lexicon()
    assert lex.term("kali mirch sabut naya") == "Black pepper whole new" and lex.term("Zephyr") == "Zephyr" and lex.is_known("x kaju") and not lex.is_known("Zephyr") and not lex.is_known(None)
    got = sentences.read("V12 ne दो सौ किलो बादाम ७९३ में", lex)
    assert (got["buyer"], got["quantity"], got["uom"], got["goods"], got["rate"]) == ("V12", 200, "KGS", "Almond", 793)


def test_cut_names_are_not_broadcast(spark):
    """Pieces are many times their names, which Spark's estimates don't know: such a side must not go through the driver."""
    rows = spark.createDataFrame([(i, f"name {i * 7919 % 10007:05d} x", "27") for i in range(40)], "ask_id long, name string, block string").where("ask_id >= 0")
    got = matching.fuzzy(rows, rows.withColumnRenamed("ask_id", "party_id"), least=95.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k#" in plan and "BroadcastHashJoin [k#" not in plan
    assert sorted((r.ask_id, r.party_id) for r in got.collect()) == [(i, i) for i in range(40)]


def test_holdout_of_many_ranges(spark):
    """Ranges are sampled anew in each job, so a count of one job's ranges says nothing about another's; null ids come last."""
    ids = spark.range(0, 500_000, 1, 24).selectExpr("IF(id = 7, NULL, id * 7919 % 500000) AS doc_id")
    got = reports.holdout(ids, "doc_id").groupBy("part").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("none"))
    assert sorted(map(tuple, got.collect())) == [("test", 75_000, 499_999, 1), ("train", 425_000, 425_000, 0)]


def test_values_are_made_once(spark):
    """Of an expression within an expression, Spark makes a copy for each use; what is costly is bound to a name instead."""
    texts = spark.createDataFrame([("Forty Four and Sixty Six paise Only",), (None,)], "x string").where("x is not null or true")
    times = lambda c, of: texts.select(c.alias("y"))._jdf.queryExecution().analyzed().toString().count(of)
    assert times(C.words_amount(F.col("x")), "words?") == 1
    assert times(documents.reconciled(F.array(C.words_amount(F.col("x")), F.lit(44).cast("decimal(20,2)"))), "words?") == 1
    assert times(printed.quantity(F.col("x")), "(?U)") == 1
    assert [r.y for r in texts.select(documents.reconciled(F.array(C.words_amount(F.col("x")), F.lit(45).cast("decimal(20,2)"))).alias("y")).collect()] == [D("44.66"), D("45.00")]
    assert [tuple(r.y) for r in texts.select(printed.quantity(F.coalesce("x", F.lit("4,000.00 kgs"))).alias("y")).collect()] == [(None, "FORTY"), (4000.0, "KGS")]
