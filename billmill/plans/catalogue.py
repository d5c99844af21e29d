"""Named queries over the driver's tables and the SQL that each has to agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import printed as P
from ..operators import accrual, blocks, documents, labels, layout, lifecycle, matching, reports, rules, sentences, spoken, tables
from ..sources import bridge, workbook
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
B = bridge.SQL


def register(name: str, sql: str | None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """The shared folder that files of a query go to; a session on one machine without one gets a folder of its own."""
    sc = spark.sparkContext
    if shared := sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None):
        return shared
    if not sc.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir has to name a shared folder")
    return tempfile.mkdtemp()


class Ledger:
    """The views of one folder."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(bridge, name)(self.spark, self.d) if hasattr(bridge, name) else bridge.read(self.spark, self.d, name)


# --- Roll-ups -------------------------------------------------------------------------------------------------------


def rollup_sql(role: str, where: str = "") -> str:
    return B + f"""SELECT t.party_id, legal_name AS party, invoice_count, coalesce(t, 0)::DOUBLE AS taxable_value, coalesce(g, 0)::DOUBLE AS grand_total, coalesce(p, 0)::DOUBLE AS paid, (coalesce(g, 0) - coalesce(p, 0))::DOUBLE AS outstanding, last_date
FROM (SELECT {role}_id AS party_id, count(*) AS invoice_count, sum(taxable_value) AS t, sum(grand_total) AS g, sum(amount_paid) AS p, max(invoice_date) AS last_date
  FROM counted WHERE {role}_id IS NOT NULL {where} GROUP BY 1 ORDER BY g DESC NULLS LAST, party_id LIMIT 100) t LEFT JOIN parties USING (party_id)"""


for _role in reports.ROLES:
    register(f"rollup_by_{_role}", rollup_sql(_role))(lambda s, d, r=_role: reports.rollup((v := Ledger(s, d)).invoices, v.parties, r))
register("rollup_by_seller_fy", rollup_sql("seller", "AND financial_year = '1996-97'"))(lambda s, d: reports.rollup((v := Ledger(s, d)).invoices, v.parties, "seller", fy="1996-97"))
register("rollup_by_buyer_dates", rollup_sql("buyer", "AND invoice_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"))(lambda s, d: reports.rollup((v := Ledger(s, d)).invoices, v.parties, "buyer", date_from="1995-01-01", date_to="1996-12-31"))

register("product_report", B + """SELECT product_id, name, category, invoice_count, q::DOUBLE AS quantity, v::DOUBLE AS value, round_even((v::DECIMAL(24,2) / nullif(q, 0)::DECIMAL(13,3))::DECIMAL(38,10), 2)::DOUBLE AS avg_rate
FROM (SELECT product_id, count(DISTINCT invoice_id) AS invoice_count, sum(quantity) AS q, sum(l.taxable_amount) AS v FROM lines l JOIN counted ON id = invoice_id GROUP BY 1) JOIN products USING (product_id)""")(
    lambda s, d: reports.product_report((v := Ledger(s, d)).plain_lines, v.invoices, v.products))

# --- Brokerage ------------------------------------------------------------------------------------------------------

RULE_ROWS = "(1, NULL, NULL, NULL, NULL, NULL, 'taxable_value', 1.25, NULL), (2, 3, NULL, NULL, NULL, NULL, 'grand_total', 0.75, NULL), (3, NULL, 1000007, NULL, NULL, NULL, 'taxable_value', 2, NULL), (4, 3, 1000007, NULL, NULL, NULL, 'taxable_value', 0, NULL), (5, NULL, NULL, 11, NULL, NULL, 'taxable_value', 1.5, NULL), (6, NULL, NULL, NULL, DATE '1996-01-01', DATE '1996-12-31', 'grand_total', 0.5, NULL), (7, 5, NULL, NULL, NULL, NULL, 'taxable_value', NULL, 0.35), (8, 5, NULL, 12, DATE '1997-01-01', NULL, 'taxable_value', 3, NULL)"
RULE_COLUMNS = "rule_id, seller_id, buyer_id, product_id, effective_from, effective_to, basis, pct, rate_per_unit"
ENTRIES = B + f""", rules({RULE_COLUMNS}) AS (SELECT * FROM (VALUES {RULE_ROWS}) t({RULE_COLUMNS})),
met AS (SELECT i.id, r.*, 4 * (r.seller_id IS NOT NULL)::INT + 4 * (r.buyer_id IS NOT NULL)::INT + 2 * (r.product_id IS NOT NULL)::INT AS score FROM invoices i JOIN rules r
  ON (r.seller_id IS NULL OR r.seller_id = i.seller_id) AND (r.buyer_id IS NULL OR r.buyer_id = i.buyer_id) AND (r.effective_from IS NULL OR i.invoice_date >= r.effective_from) AND (r.effective_to IS NULL OR i.invoice_date <= r.effective_to)
  AND (r.product_id IS NULL OR EXISTS (SELECT 1 FROM lines l WHERE l.invoice_id = i.id AND l.product_id = r.product_id))),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, rule_id) = 1),
entries AS (
  SELECT i.id AS invoice_id, b.rule_id, coalesce(CASE WHEN basis = 'grand_total' THEN nullif(grand_total, 0) ELSE nullif(taxable_value, 0) END, nullif(taxable_value, 0), grand_total, 0)::DECIMAL(18,2) AS basis_amount,
    coalesce(round_even((nullif(rate_per_unit, 0)::DECIMAL(9,4) * nullif(total_quantity, 0)::DECIMAL(18,3))::DECIMAL(28,7), 2),
      round_even((coalesce(CASE WHEN basis = 'grand_total' THEN nullif(grand_total, 0) ELSE nullif(taxable_value, 0) END, nullif(taxable_value, 0), grand_total, 0)::DECIMAL(18,2)::DECIMAL(24,2) * coalesce(pct, 1)::DECIMAL(7,4) * 0.01::DECIMAL(3,2))::DECIMAL(34,8), 2))::DECIMAL(18,2) AS amount, financial_year
  FROM invoices i LEFT JOIN best b ON b.id = i.id)
"""


def rule_table(s: SparkSession) -> DataFrame:
    return s.sql(f"SELECT rule_id, cast(seller_id AS bigint) AS seller_id, cast(buyer_id AS bigint) AS buyer_id, cast(product_id AS bigint) AS product_id, effective_from, effective_to, basis, cast(pct AS decimal(9,4)) AS pct, cast(rate_per_unit AS decimal(9,4)) AS rate_per_unit FROM VALUES {RULE_ROWS} AS t({RULE_COLUMNS})")


def entries(s: SparkSession, d: str) -> DataFrame:
    v = Ledger(s, d)
    return accrual.accrued(v.invoices, rule_table(s), v.plain_lines)


register("brokerage_accrual", ENTRIES + "SELECT invoice_id, rule_id, basis_amount::DOUBLE AS basis_amount, amount::DOUBLE AS amount FROM entries")(
    lambda s, d: entries(s, d).select("invoice_id", F.col("rule_id").cast("int").alias("rule_id"), F.col("basis_amount").cast("double").alias("basis_amount"), F.col("amount").cast("double").alias("amount")))
register("brokerage_open_entries", ENTRIES + "SELECT invoice_id, amount::DOUBLE AS amount FROM entries WHERE invoice_id % 17 <> 0")(
    lambda s, d: accrual.open_entries(entries(s, d), Ledger(s, d).invoices.where("id % 17 = 0").select(F.col("id").alias("invoice_id"))).select("invoice_id", F.col("amount").cast("double").alias("amount")))

SUMMARY = ENTRIES + """SELECT n AS invoice_count, sellers, coalesce(g, 0)::DOUBLE AS turnover, coalesce(t, 0)::DOUBLE AS taxable, x::DOUBLE AS tax, coalesce(p, 0)::DOUBLE AS paid, (coalesce(g, 0) - coalesce(p, 0))::DOUBLE AS outstanding, coalesce(b, 0)::DOUBLE AS brokerage
FROM (SELECT count(*) AS n, count(DISTINCT seller_id) AS sellers, sum(grand_total) AS g, sum(taxable_value) AS t, coalesce(sum(cgst_amount), 0) + coalesce(sum(sgst_amount), 0) + coalesce(sum(igst_amount), 0) AS x, sum(amount_paid) AS p FROM counted WHERE {w}), (SELECT sum(amount) AS b FROM entries WHERE {w})"""
register("summary", SUMMARY.replace("{w}", "true"))(lambda s, d: reports.summary(Ledger(s, d).invoices, entries(s, d)))
register("summary_fy", SUMMARY.replace("{w}", "financial_year = '1995-96'"))(lambda s, d: reports.summary(Ledger(s, d).invoices, entries(s, d), fy="1995-96"))
register("kpi_ratios", ENTRIES + """SELECT coalesce(round_even((g::DECIMAL(24,2) / nullif(n, 0)::DECIMAL(18,0))::DECIMAL(38,8), 2), 0)::DOUBLE AS average_bill, coalesce(round_even((b::DECIMAL(24,2) * 100 / nullif(t, 0)::DECIMAL(24,2))::DECIMAL(38,8), 4), 0)::DOUBLE AS brokerage_pct
FROM (SELECT count(*) AS n, sum(grand_total) AS g, sum(taxable_value) AS t FROM counted), (SELECT sum(amount) AS b FROM entries)""")(lambda s, d: reports.kpis(Ledger(s, d).invoices, entries(s, d)))
register("timeline", ENTRIES + """SELECT m.month, label, invoice_count, g::DOUBLE AS turnover, coalesce(t, 0)::DOUBLE AS taxable, coalesce(b, 0)::DOUBLE AS brokerage
FROM (SELECT strftime(invoice_date, '%Y-%m') AS month, strftime(invoice_date, '%b %Y') AS label, count(*) AS invoice_count, sum(grand_total) AS g, sum(taxable_value) AS t FROM counted GROUP BY 1, 2) m
LEFT JOIN (SELECT strftime(invoice_date, '%Y-%m') AS month, sum(amount) AS b FROM entries JOIN counted ON id = invoice_id GROUP BY 1) e USING (month)""")(lambda s, d: reports.timeline(Ledger(s, d).invoices, entries(s, d)))

# --- Counts, profiles, queues ---------------------------------------------------------------------------------------

DOC_STATUS = "CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'processed' ELSE 'queued' END"
register("status_histogram", B + f"SELECT 'invoice' AS kind, status, count(*) AS n FROM invoices GROUP BY ALL UNION ALL SELECT 'document', {DOC_STATUS}, count(*) FROM documents GROUP BY ALL")(
    lambda s, d: reports.status_histogram((v := Ledger(s, d)).invoices, v.documents.select(F.expr(DOC_STATUS).alias("status"))))
register("available_years", B + "SELECT DISTINCT financial_year FROM invoices WHERE financial_year IS NOT NULL")(lambda s, d: reports.available_years(Ledger(s, d).invoices))
register("party_profile", B + " UNION ALL ".join(f"SELECT {r}_id AS party_id, '{r}' AS role, count(*) AS invoice_count, sum(grand_total)::DOUBLE AS grand_total, coalesce(sum(taxable_value), 0)::DOUBLE AS taxable_value, min(invoice_date) AS first_date, max(invoice_date) AS last_date FROM counted WHERE {r}_id IS NOT NULL GROUP BY ALL" for r in reports.ROLES))(
    lambda s, d: reports.party_profile(Ledger(s, d).invoices))
EDITS = "CASE WHEN event_type <> 'view' THEN event_type END AS hint, 'f' || (user_id % 5) AS field"
register("corrections_report", f"SELECT coalesce(hint, 'unknown') AS hint, field, n FROM (SELECT {EDITS}, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, hint NULLS FIRST, field LIMIT 50)")(
    lambda s, d: reports.corrections(Ledger(s, d).events.selectExpr("CASE WHEN event_type <> 'view' THEN event_type END AS hint", "concat('f', user_id % 5) AS field")))
CONFIDENCE_FLAGS = "SELECT id AS invoice_id, 'low_confidence' AS rule, CASE WHEN confidence < 0.6 THEN 'error' ELSE 'warning' END AS severity, 'overall_confidence' AS field_path FROM invoices WHERE confidence < 0.85"
register("review_queue", B + f"""SELECT id, confidence, status, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings FROM (SELECT * FROM invoices WHERE needs_review ORDER BY confidence NULLS FIRST, id DESC LIMIT 200)
LEFT JOIN (SELECT invoice_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM ({CONFIDENCE_FLAGS}) GROUP BY 1) ON id = invoice_id""")(
    lambda s, d: reports.review_queue((v := Ledger(s, d).invoices), rules.confidence(v)))
register("seller_concentration", B + """SELECT least(rank, 5) AS rank, CASE WHEN rank <= 4 THEN legal_name ELSE 'Everyone else' END AS name, sum(g)::DOUBLE AS turnover, round_even((sum(g)::DECIMAL(30,2) * 100 / any_value(total)::DECIMAL(24,2))::DECIMAL(38,8), 1)::DOUBLE AS share
FROM (SELECT seller_id, sum(grand_total) AS g, row_number() OVER (ORDER BY sum(grand_total) DESC, seller_id) AS rank, sum(sum(grand_total)) OVER () AS total FROM counted WHERE seller_id IS NOT NULL GROUP BY 1) LEFT JOIN parties ON party_id = seller_id GROUP BY 1, 2""")(
    lambda s, d: reports.concentration((v := Ledger(s, d)).invoices, v.parties))

# --- Lists, searches, exports ---------------------------------------------------------------------------------------

SORTS = {"date_desc": "invoice_date DESC NULLS LAST", "date_asc": "invoice_date ASC NULLS FIRST", "amount_desc": "grand_total DESC NULLS LAST", "amount_asc": "grand_total ASC NULLS FIRST", "recent": "id DESC"}
for _sort, _order in SORTS.items():
    register(f"list_invoices_{_sort}", B + f"SELECT id, invoice_date, grand_total::DOUBLE AS grand_total FROM invoices ORDER BY {_order}, id DESC LIMIT 100 OFFSET 20")(
        lambda s, d, o=_sort: reports.page(Ledger(s, d).invoices, o, 100, 20).select("id", "invoice_date", F.col("grand_total").cast("double").alias("grand_total")))
register("report_footer", B + "SELECT count(*) AS n, sum(grand_total)::DOUBLE AS grand_total, coalesce(sum(taxable_value), 0)::DOUBLE AS taxable_value FROM (SELECT * FROM invoices WHERE status = 'confirmed' ORDER BY grand_total DESC NULLS LAST, id DESC LIMIT 100)")(
    lambda s, d: reports.page_totals(reports.page(Ledger(s, d).invoices, "amount_desc", status="confirmed", seller_id=0)))
for _key, _q in (("search_invoices_wildcard", "inv-_3"),):
    register(_key, B + f"""SELECT id, status FROM invoices WHERE invoice_number ILIKE '%{_q.strip()}%' OR financial_year ILIKE '%{_q.strip()}%' OR status ILIKE '%{_q.strip()}%' OR broker_name_raw ILIKE '%{_q.strip()}%'
OR seller_id IN (SELECT party_id FROM parties WHERE legal_name ILIKE '%{_q.strip()}%') OR buyer_id IN (SELECT party_id FROM parties WHERE legal_name ILIKE '%{_q.strip()}%')""")(
        lambda s, d, q=_q: reports.search((v := Ledger(s, d)).invoices, v.parties, q).select("id", "status"))
register("party_search", B + "SELECT party_id, legal_name, city FROM parties WHERE role = 'buyer' AND (legal_name ILIKE '%7%' OR city ILIKE '%7%') ORDER BY legal_name, party_id LIMIT 50")(
    lambda s, d: reports.party_search(Ledger(s, d).parties, "buyer", "7").select("party_id", "legal_name", "city"))
register("holdout_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= greatest(1, floor(count(*) OVER () * 0.85)) THEN 'train' ELSE 'test' END AS part FROM documents")(lambda s, d: reports.holdout(Ledger(s, d).documents.select("doc_id"), "doc_id"))
TERMS = "SELECT trim(t) AS term FROM (SELECT unnest([p_name, p_brand, p_type]) AS t FROM part) WHERE length(trim(t)) >= 3 AND NOT regexp_matches(t, '\\d')"
register("learned_terms", f"SELECT term, count(*) AS n FROM ({TERMS}) GROUP BY 1 ORDER BY n DESC, term LIMIT 40")(lambda s, d: reports.terms(Ledger(s, d).part, ["p_name", "p_brand", "p_type"]))
register("known_values", f"SELECT DISTINCT term FROM ({TERMS})")(lambda s, d: reports.terms(Ledger(s, d).part, ["p_name", "p_brand", "p_type"], None))


def export_workbook(s: SparkSession, d: str) -> DataFrame:
    """Counted bills and their lines written into workbooks; the lines as they are read from there."""
    v = Ledger(s, d)
    bills = bridge.counted(v.invoices).selectExpr("id", "invoice_number", "invoice_date", "grand_total")
    lines = v.lines.join(bills.select(F.col("id").alias("invoice_id")), "invoice_id", "left_semi").select("invoice_id", "line_no", "product_id", "quantity", "taxable_amount")
    return workbook.rows(workbook.workbooks(bills, lines, "invoice_id"), "Line Items", "invoice_id string, line_no string, product_id string, quantity string, taxable_amount string")


register("export_workbook", B + "SELECT invoice_id::VARCHAR AS invoice_id, line_no::VARCHAR AS line_no, product_id::VARCHAR AS product_id, quantity::VARCHAR AS quantity, taxable_amount::VARCHAR AS taxable_amount FROM lines WHERE invoice_id IN (SELECT id FROM counted)")(export_workbook)

# --- Checks ---------------------------------------------------------------------------------------------------------

register("duplicates", B + "SELECT id, first_id FROM (SELECT id, row_number() OVER w AS n, first_value(id) OVER w AS first_id FROM invoices WHERE seller_id IS NOT NULL WINDOW w AS (PARTITION BY seller_id, invoice_number, financial_year ORDER BY id)) WHERE n > 1")(lambda s, d: rules.duplicates(Ledger(s, d).invoices))
register("first_bill", B + "SELECT seller_id, min(id) AS id FROM invoices WHERE seller_id IS NOT NULL GROUP BY 1")(lambda s, d: rules.first_bills(Ledger(s, d).invoices))
EXTRA = """, extra AS (SELECT i.*, n_lines, lines_sum, lines_quantity, CASE WHEN id % 19 = 0 THEN -100.5 END::DECIMAL(18,2) AS discounts, CASE WHEN id % 23 = 0 THEN 825 END::DECIMAL(18,2) AS additions, CASE WHEN id % 5 = 0 THEN 0.4 END::DECIMAL(18,2) AS charge_round, NULL::DECIMAL(18,2) AS charge_tcs,
  NULL::DECIMAL(18,2) AS cess_amount, CASE WHEN id % 2 = 0 THEN 0 END::DECIMAL(18,2) AS tcs_amount, CASE WHEN id % 3 = 0 THEN id % 4 - 1.5 END::DECIMAL(18,2) AS round_off, NULL::DECIMAL(18,2) AS other_charges,
  CASE WHEN id % 4 = 0 THEN invoice_date - 3 ELSE invoice_date + 30 END AS due_date, CASE WHEN id % 3 = 0 THEN repeat('a', 60 + (id % 7)::INT) ELSE '' END AS irn, CASE WHEN id % 5 = 0 THEN ' ' || repeat('1', 10 + (id % 4)::INT) END AS eway_bill_no,
  lpad((seller_id % 5)::VARCHAR, 2, '0') AS seller_state, lpad((buyer_id % 5)::VARCHAR, 2, '0') AS buyer_state, CASE WHEN id % 6 = 0 THEN '03' END AS consignee_state
  FROM invoices i LEFT JOIN (SELECT invoice_id, count(*) AS n_lines, sum(taxable_amount) AS lines_sum, sum(quantity) AS lines_quantity FROM lines GROUP BY 1) ON id = invoice_id)
"""


def extra(s: SparkSession, d: str) -> DataFrame:
    """Bills with sums of lines, and with made-up charges, dates and numbers for the rules to look at."""
    v = Ledger(s, d)
    sums = v.plain_lines.groupBy("invoice_id").agg(F.count("*").alias("n_lines"), F.sum("taxable_amount").alias("lines_sum"), F.sum("quantity").alias("lines_quantity"))
    e = lambda sql: F.expr(sql)
    return v.invoices.join(sums, F.col("id") == F.col("invoice_id"), "left").drop("invoice_id").withColumns({
        "discounts": e("cast(CASE WHEN id % 19 = 0 THEN -100.5 END AS decimal(18,2))"), "additions": e("cast(CASE WHEN id % 23 = 0 THEN 825 END AS decimal(18,2))"), "charge_round": e("cast(CASE WHEN id % 5 = 0 THEN 0.4 END AS decimal(18,2))"), "charge_tcs": e("cast(NULL AS decimal(18,2))"),
        "cess_amount": e("cast(NULL AS decimal(18,2))"), "tcs_amount": e("cast(CASE WHEN id % 2 = 0 THEN 0 END AS decimal(18,2))"), "round_off": e("cast(CASE WHEN id % 3 = 0 THEN id % 4 - 1.5 END AS decimal(18,2))"), "other_charges": e("cast(NULL AS decimal(18,2))"),
        "due_date": e("CASE WHEN id % 4 = 0 THEN date_sub(invoice_date, 3) ELSE date_add(invoice_date, 30) END"), "irn": e("CASE WHEN id % 3 = 0 THEN repeat('a', cast(60 + id % 7 AS int)) ELSE '' END"), "eway_bill_no": e("CASE WHEN id % 5 = 0 THEN concat(' ', repeat('1', cast(10 + id % 4 AS int))) END"),
        "seller_state": e("lpad(cast(seller_id % 5 AS string), 2, '0')"), "buyer_state": e("lpad(cast(buyer_id % 5 AS string), 2, '0')"), "consignee_state": e("CASE WHEN id % 6 = 0 THEN '03' END"),
    })


def flags_sql(rows: list[tuple[str, str, str, str]], source: str = "extra") -> str:
    return B + EXTRA + " UNION ALL ".join(f"SELECT id AS invoice_id, '{r}' AS rule, {sev if ' ' in sev else repr(sev)} AS severity, '{path}' AS field_path FROM {source} WHERE {when}" for r, sev, path, when in rows)


REQUIRED = [("missing_required_field", "error", c, f"{c} IS NULL") for c in ("invoice_number", "invoice_date", "grand_total", "seller_id", "buyer_id")] + [("no_line_items", "error", "lines", "n_lines IS NULL")]
register("flags_required", flags_sql(REQUIRED))(lambda s, d: rules.required(extra(s, d)))
_l, _dc, _ad = "coalesce(lines_sum, 0)", "coalesce(discounts, 0)", "coalesce(additions, 0)"
_base = f"coalesce(taxable_value, {_l} + {_dc})"
_tax = "coalesce(cgst_amount, 0) + coalesce(sgst_amount, 0) + coalesce(igst_amount, 0) + coalesce(cess_amount, 0)"
_tcs, _ro, _ot = "coalesce(nullif(tcs_amount, 0), charge_tcs, 0)", "coalesce(round_off, charge_round, 0)", f"coalesce(other_charges, {_ad})"
TOTALS = [
    ("taxable_value_mismatch", "error", "taxable_value", f"n_lines > 0 AND least(abs({_l} - taxable_value), abs({_l} + {_dc} - taxable_value), abs({_l} + {_dc} + {_ad} - taxable_value), abs({_l} + {_ad} - taxable_value)) > 1"),
    ("grand_total_mismatch", "error", "grand_total", f"least(abs({_base} + {_tax} + {_ot} + {_tcs} + {_ro} - grand_total), abs({_base} + {_tax} + {_tcs} + {_ro} - grand_total), abs({_base} + {_tax} + {_ot} + {_tcs} - grand_total)) > 1"),
    ("quantity_mismatch", "warning", "total_quantity", "n_lines > 0 AND abs(lines_quantity - total_quantity) > 0.01"),
]
register("flags_totals", flags_sql(TOTALS))(lambda s, d: rules.totals(extra(s, d)))
_b = "coalesce(consignee_state, buyer_state)"
SUPPLY = [("supply_type_mismatch", "error", "igst_amount", f"seller_state = {_b} AND igst_amount > 1"), ("supply_type_mismatch", "error", "cgst_amount", f"seller_state <> {_b} AND coalesce(cgst_amount, 0) + coalesce(sgst_amount, 0) > 1"), ("cgst_sgst_unequal", "warning", "sgst_amount", f"seller_state = {_b} AND abs(cgst_amount - sgst_amount) > 1")]
register("flags_supply_type", flags_sql(SUPPLY))(lambda s, d: rules.supply(extra(s, d)))
FORMATS = [("round_off_out_of_range", "warning", "round_off", "abs(round_off) >= 1"), ("date_in_future", "warning", "invoice_date", "invoice_date > DATE '1998-06-01' + 1"), ("date_implausible", "warning", "invoice_date", "invoice_date < DATE '2000-01-01'"), ("due_before_invoice", "warning", "due_date", "due_date < invoice_date"), ("irn_length", "warning", "irn", "irn <> '' AND length(irn) <> 64"), ("eway_bill_length", "warning", "eway_bill_no", "eway_bill_no <> '' AND length(trim(eway_bill_no)) <> 12")]
register("flags_formats", flags_sql(FORMATS))(lambda s, d: rules.formats(extra(s, d), "1998-06-01"))
register("flags_confidence", B + CONFIDENCE_FLAGS)(lambda s, d: rules.confidence(Ledger(s, d).invoices))
COMPLETE = [("transporter_missing", "warning", "transporter_id", "eway_bill_no <> '' AND transporter_id IS NULL"), ("broker_unresolved", "warning", "broker_id", "trim(broker_name_raw) <> '' AND broker_id IS NULL")]
register("flags_completeness", flags_sql(COMPLETE) + " UNION ALL SELECT invoice_id, 'line_without_description', 'warning', 'lines.' || line_no || '.description' FROM lines WHERE product_id % 10 = 0 UNION ALL SELECT id, 'field_not_captured', 'warning', 'PO' FROM extra WHERE id % 8 = 0")(
    lambda s, d: rules.completeness(extra(s, d).withColumn("unmapped_fields", F.expr("array(named_struct('label', 'PO', 'value', '', 'section', IF(id % 8 = 0, 'not_captured', 'header')))")), Ledger(s, d).lines.withColumn("description", F.expr("IF(product_id % 10 = 0, ' ', 'goods')"))))
register("flags_line_arithmetic", B + "SELECT invoice_id, 'line_arithmetic' AS rule, 'warning' AS severity, 'lines.' || line_no || '.taxable_amount' AS field_path FROM lines WHERE abs(CASE WHEN line_no % 2 = 0 AND discount <> 0 THEN quantity * 1000::DECIMAL(18,4) * (1 - discount) ELSE quantity * 1000::DECIMAL(18,4) - 5 END - taxable_amount) > 2")(
    lambda s, d: rules.line_arithmetic(Ledger(s, d).lines.withColumns({"rate": F.lit(1000).cast("decimal(18,4)"), "discount_pct": F.expr("IF(line_no % 2 = 0, cast(discount * 100 AS decimal(9,4)), NULL)"), "discount_amount": F.lit(-5).cast("decimal(18,2)")})))
register("flags_hsn", B + "SELECT invoice_id, 'hsn_format' AS rule, 'warning' AS severity, 'lines.' || line_no || '.hsn' AS field_path FROM (SELECT *, repeat('8', (product_id % 11)::INT + 1) AS h FROM lines) WHERE CASE WHEN length(h) IN (3, 5, 7) THEN length(h) + 1 ELSE length(h) END NOT IN (4, 6, 8)")(
    lambda s, d: rules.hsn_format(Ledger(s, d).lines.withColumn("hsn", F.expr("repeat('8', cast(product_id % 11 + 1 AS int))"))))
TAXROWS = "SELECT invoice_id, line_no AS row_no, taxable_amount AS taxable_value, CASE WHEN line_no % 2 = 0 THEN 2.5 END::DECIMAL(9,4) AS cgst_rate, CASE WHEN line_no % 2 = 0 THEN tax_amount END AS cgst_amount, 0::DECIMAL(9,4) AS sgst_rate, tax_amount AS sgst_amount, 5::DECIMAL(9,4) AS igst_rate, CASE WHEN line_no % 3 = 0 THEN NULL ELSE tax_amount END AS igst_amount FROM lines"
register("flags_tax", B + f", rows AS ({TAXROWS}), tax_heads AS (SELECT *, 'cgst' AS head, cgst_rate AS r, cgst_amount AS a FROM rows UNION ALL SELECT *, 'sgst', sgst_rate, sgst_amount FROM rows UNION ALL SELECT *, 'igst', igst_rate, igst_amount FROM rows), rowsums AS (SELECT invoice_id, coalesce(sum(cgst_amount), 0) AS c, coalesce(sum(sgst_amount), 0) AS s, coalesce(sum(igst_amount), 0) AS g FROM rows GROUP BY 1)"
    " SELECT invoice_id, 'tax_computation' AS rule, 'warning' AS severity, 'tax_rows.' || row_no || '.' || head AS field_path FROM tax_heads WHERE r <> 0 AND abs(taxable_value * r * 0.01::DECIMAL(3,2) - a) > 1"
    + "".join(f" UNION ALL SELECT id, 'tax_summary_mismatch', 'warning', '{h}_amount' FROM invoices JOIN rowsums ON id = invoice_id WHERE abs({h}_amount - {k}) > 1" for h, k in (("cgst", "c"), ("sgst", "s"), ("igst", "g"))))(
    lambda s, d: rules.tax_rows(Ledger(s, d).lines.selectExpr("invoice_id", "line_no AS row_no", "taxable_amount AS taxable_value", "cast(IF(line_no % 2 = 0, 2.5, NULL) AS decimal(9,4)) AS cgst_rate", "IF(line_no % 2 = 0, tax_amount, NULL) AS cgst_amount", "cast(0 AS decimal(9,4)) AS sgst_rate", "tax_amount AS sgst_amount", "cast(5 AS decimal(9,4)) AS igst_rate", "IF(line_no % 3 = 0, NULL, tax_amount) AS igst_amount"), Ledger(s, d).invoices))
register("flags_severity", B + f"SELECT invoice_id, CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END AS severity, count(*) AS n_flags FROM ({CONFIDENCE_FLAGS}) GROUP BY 1")(lambda s, d: rules.worst(rules.confidence(Ledger(s, d).invoices)))
register("invoice_status_after_rules", B + f"SELECT id, status AS before, CASE WHEN status = 'confirmed' THEN status WHEN id IN (SELECT invoice_id FROM ({CONFIDENCE_FLAGS})) THEN 'needs_review' ELSE 'extracted' END AS after FROM invoices")(
    lambda s, d: rules.statuses((v := Ledger(s, d).invoices), rules.confidence(v)))
register("readings_diff", B + "SELECT id, 'invoice_number' AS field, invoice_number AS first, CASE WHEN id % 4 = 0 THEN 'X' ELSE ' ' || lower(invoice_number) END AS second FROM invoices WHERE id % 4 = 0 UNION ALL SELECT id, 'financial_year', financial_year, NULL FROM invoices WHERE id % 9 = 0")(
    lambda s, d: rules.differing((v := Ledger(s, d).invoices.select("id", "invoice_number", "financial_year")), v.selectExpr("id", "IF(id % 4 = 0, 'X', concat(' ', lower(invoice_number))) AS invoice_number", "IF(id % 9 = 0, NULL, financial_year) AS financial_year"), ["invoice_number", "financial_year"]))

# --- Cleaners -------------------------------------------------------------------------------------------------------

register("clean_amounts", "SELECT o_orderkey AS id, v::DOUBLE AS clean FROM (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) * CASE WHEN o_orderkey % 5 IN (1, 2) THEN -1 ELSE 1 END AS v FROM orders)")(
    lambda s, d: Ledger(s, d).orders.select(F.col("o_orderkey").alias("id"), C.amount(F.expr("CASE o_orderkey % 5 WHEN 0 THEN concat('Rs.', format_number(o_totalprice, 2)) WHEN 1 THEN concat('(', format_number(o_totalprice, 2), ')') WHEN 2 THEN concat('(-)', format_number(o_totalprice, 2)) WHEN 3 THEN concat('₹ ', format_number(o_totalprice, 2), ' INR') ELSE format_number(o_totalprice, 2) END")).cast("double").alias("clean")))
register("clean_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 6 THEN o_orderdate::DATE END AS clean FROM orders")(
    lambda s, d: Ledger(s, d).orders.select(F.col("o_orderkey").alias("id"), C.date(F.expr("CASE o_orderkey % 7 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN upper(date_format(o_orderdate, 'd-MMM-yyyy')) WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 3 THEN concat(date_format(o_orderdate, 'd-M-yyyy'), ' 6:31 PM') WHEN 4 THEN date_format(o_orderdate, 'd.M.yyyy') WHEN 5 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE '2026-13-45' END")).alias("clean")))
register("states", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Karnataka' END AS state FROM part")(lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), C.lookup(C.STATES)[F.element_at(F.array(F.lit("27"), F.lit("29"), F.lit("28")), (F.col("p_partkey") % 3 + 1).cast("int"))].alias("state")))
register("clean_hsn", "SELECT p_partkey AS id, CASE WHEN length(h) IN (3, 5, 7) THEN '0' || h ELSE h END AS hsn FROM (SELECT p_partkey, (p_partkey * 37)::VARCHAR AS h FROM part)")(lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), C.hsn(F.concat((F.col("p_partkey") * 37).cast("string"), F.lit(" ."))).alias("hsn")))
register("clean_uom", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'KGS' WHEN 1 THEN 'MTS' WHEN 2 THEN 'DRUMSOFOILAN' END AS uom FROM part")(lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), C.unit(F.element_at(F.array(*map(F.lit, ("Kilo.", "TONNE", "drums of oil and", "12"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("uom")))
register("product_names", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")(lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), C.product_key(F.col("p_name")).alias("key")))
register("indian_group", """SELECT o_orderkey AS id, CASE WHEN w < 1000 THEN w::VARCHAR WHEN w < 100000 THEN (w // 1000) || ',' || lpad((w % 1000)::VARCHAR, 3, '0') WHEN w < 10000000 THEN (w // 100000) || ',' || lpad((w // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad((w % 1000)::VARCHAR, 3, '0')
ELSE (w // 10000000) || ',' || lpad((w // 100000 % 100)::VARCHAR, 2, '0') || ',' || lpad((w // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad((w % 1000)::VARCHAR, 3, '0') END || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS grouped
FROM (SELECT o_orderkey, c // 100 AS w, c FROM (SELECT o_orderkey, (o_totalprice::DECIMAL(18,2) * 100 * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 100 END)::BIGINT AS c FROM orders))""")(
    lambda s, d: Ledger(s, d).orders.select(F.col("o_orderkey").alias("id"), C.indian((bridge.money(F.col("o_totalprice")) * F.expr("IF(o_orderkey % 2 = 0, 1, 100)")).cast("decimal(20,2)")).alias("grouped")))
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
register("words_to_number", "SELECT p_partkey AS id, (p_partkey % 8 + 2) * 10 * 100000 + (p_partkey % 8 + 2) * 10 * 1000 + 700 + (p_partkey % 8 + 2) * 10 AS value FROM part")(
    lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), C.words_value(F.concat_ws(" ", F.lit("INR"), (t := F.element_at(F.array(*map(F.lit, TENS)), (F.col("p_partkey") % 8 + 1).cast("int"))), F.lit("Lakhs"), t, F.lit("Thousand Seven Hundred and"), t, F.lit("only"))).alias("value")))
register("due_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate::DATE + (o_orderkey % 60)::INT END AS due FROM orders")(
    lambda s, d: Ledger(s, d).orders.select(F.col("o_orderkey").alias("id"), C.due_date(F.col("o_orderdate").cast("date"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderkey % 60, ' Days') WHEN 1 THEN concat('net ', o_orderkey % 60, 'd') WHEN 2 THEN concat('within ', o_orderkey % 60, ' day') ELSE 'cash' END")).alias("due")))
register("category_guess", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Almonds' WHEN 1 THEN 'Dates' WHEN 2 THEN 'Nuts' WHEN 3 THEN 'Dry Fruits' END AS category FROM part")(
    lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), C.category(F.expr("element_at(array('badam giri', 'update', 'x', 'x', 'x'), cast(p_partkey % 5 + 1 AS int))"), F.expr("element_at(array('', '', '08021200', '0813', '1006'), cast(p_partkey % 5 + 1 AS int))")).alias("category")))
_kw = "+".join(f"contains(lower(text), '{w}')::INT" for w in C.BILL_WORDS)
register("page_quality", f"""SELECT doc_id, score, CASE WHEN score >= 0.6 THEN 'text_layer' ELSE 'ocr_vision' END AS route FROM (SELECT doc_id, CASE WHEN length(b) > 0 THEN round(0.5 * least(({_kw}) / 8.0::DOUBLE, 1) + 0.2 * least(length(regexp_replace(b, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(b) / 0.45::DOUBLE, 1) + 0.3 * CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: regexp_matches(x, '[aeiouAEIOU]')))::DOUBLE / len(t) ELSE 0 END, 4) ELSE 0 END AS score
FROM (SELECT doc_id, text, regexp_replace(text, '\\s', '', 'g') AS b, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS t FROM documents))""")(
    lambda s, d: lifecycle.spread(Ledger(s, d).documents.select("doc_id", "text")).select("doc_id", C.text_score(F.col("text")).alias("score")).withColumn("route", F.when(F.col("score") >= 0.6, "text_layer").otherwise("ocr_vision")))
register("content_dedupe", "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")(lambda s, d: matching.first_of_content(Ledger(s, d).documents, "doc_id", "text"))

# --- Documents ------------------------------------------------------------------------------------------------------

register("jws_payload", "SELECT p_partkey AS id, 'D' || p_partkey AS number FROM part")(
    lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), documents.jws_claim(F.concat(F.lit("h."), F.translate(F.regexp_replace(F.base64(F.to_json(F.struct(F.to_json(F.struct(F.concat(F.lit("D"), F.col("p_partkey")).alias("DocNo"))).alias("data")))), "[=\r\n]", ""), "+/", "-_"), F.lit(".s")), "$.DocNo").alias("number")))
register("eway_qr", "SELECT p_partkey AS id, p_partkey::VARCHAR AS number FROM part")(lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), documents.eway_part(F.concat(F.lit("GSTIN: 27X/EwbNo: "), F.col("p_partkey"), F.lit(" /Dt: x")), "EwbNo").alias("number")))
register("row_classify", "SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 7 WHEN 0 THEN 'tax' WHEN 1 THEN 'goods' WHEN 2 THEN 'charge:packing' WHEN 3 THEN 'total' WHEN 4 THEN 'charge:other' WHEN 5 THEN 'charge:round_off' ELSE 'total' END AS class FROM lineitem")(
    lambda s, d: Ledger(s, d).lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), documents.row_class(F.expr("element_at(array('Output CGST @ 2.5%', 'Walnuts packing', 'PACKING & LABOUR 5%', 'Sub Total', 'Mandi fee', 'Round Off', ''), cast(l_linenumber % 7 + 1 AS int))"), F.expr("IF(l_linenumber % 7 = 1, '5', '')"), F.lit("10.00")).alias("class")))
register("row_repair", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN right(p_partkey::VARCHAR, 3) WHEN 1 THEN '12' ELSE '' END AS serial, CASE p_partkey % 3 WHEN 0 THEN 'ALMOND kernels' WHEN 1 THEN 'kernels' ELSE 'ALMOND kernels' END AS description FROM part")(
    lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), documents.unglued(F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(right(cast(p_partkey AS string), 3), 'ALMOND') WHEN 1 THEN '12' ELSE 'ALMOND' END"), F.lit("kernels")).alias("x")).select("id", "x.*"))
register("grand_total_reconcile", B + "SELECT id, CASE WHEN id % 3 = 0 THEN grand_total + 50 ELSE grand_total END::DOUBLE AS grand_total FROM invoices")(
    lambda s, d: Ledger(s, d).invoices.select("id", documents.reconciled(F.expr("array(IF(id % 3 = 1, grand_total + 900, IF(id % 3 = 0, grand_total + 50, grand_total)), IF(id % 3 = 2, NULL, IF(id % 3 = 0, grand_total + 50.5, grand_total)), IF(id % 3 = 2, grand_total + 5000, grand_total))")).cast("double").alias("grand_total")))
register("reading_confidence", B + "SELECT id, least(0.5 + CASE WHEN id % 3 >= 2 THEN 0.2 ELSE 0 END + CASE WHEN id % 5 > 0 THEN 0.05 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 0.1 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 0.05 ELSE 0 END, 0.98)::DOUBLE AS confidence FROM invoices")(
    lambda s, d: Ledger(s, d).invoices.select("id", documents.reading_confidence(F.col("id") % 3, F.col("id") % 5, F.col("id") % 7 == 0, F.col("id") % 2 == 0, F.col("id") % 4 == 0).alias("confidence")))
register("qr_consistency", "SELECT p_partkey AS id, p_partkey % 3 <> 0 AS consistent FROM part")(lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), documents.consistent(F.lit("Bill NGA/1634 of 27NGACL2841M1ZO to 29SNRTB4426N2ZQ"), F.expr("IF(p_partkey % 3 = 0, 'zz', 'nga-1634')"), F.lit("27ngacl2841m1zo"), F.expr("IF(p_partkey % 3 = 1, NULL, 'none')")).alias("consistent")))

# --- Matching and jobs ----------------------------------------------------------------------------------------------

register("resolve_exact_tiers", B + "SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 0 THEN 1000001 ELSE 1000000 + c_custkey END AS party_id, CASE c_custkey % 3 WHEN 0 THEN 'by_gstin' WHEN 1 THEN 'by_name' END AS tier FROM customer")(
    lambda s, d: matching.exact_tiers(Ledger(s, d).customer.selectExpr("c_custkey AS ask_id", "IF(c_custkey % 3 = 2, 'nobody', concat(c_name, ' Pvt Ltd')) AS name", "IF(c_custkey % 3 = 0, 'G1000001', NULL) AS gstin", "'00' AS state_code"), Ledger(s, d).parties.where("role = 'buyer'").withColumn("gstin", F.concat(F.lit("G"), F.col("party_id"))), s.createDataFrame([], "alias string, party_id long")))
register("resolve_fuzzy", None)(lambda s, d: matching.fuzzy(Ledger(s, d).part.selectExpr("p_partkey AS ask_id", "concat(p_name, ' s') AS name", "p_brand AS block"), Ledger(s, d).part.selectExpr("p_partkey AS party_id", "p_name AS name", "p_brand AS block")))
register("job_requeue", "SELECT event_id AS id, CASE WHEN ts < TIMESTAMP '2024-01-15' - INTERVAL 30 MINUTE THEN 'queued' ELSE 'running' END AS status FROM events")(
    lambda s, d: jobs.requeued(Ledger(s, d).events.select(F.col("event_id").alias("id"), F.lit("running").alias("status"), F.col("ts").alias("started_at")), "2024-01-15").select("id", "status"))

# --- Spoken deals ---------------------------------------------------------------------------------------------------

SAID = "SELECT l_orderkey AS id, l_linenumber AS line, (l_quantity::DECIMAL(10,0) * 0.125::DECIMAL(4,3))::DECIMAL(16,3) AS quantity, l_extendedprice::DECIMAL(16,2) AS rate FROM lineitem"
register("trade_values", f"SELECT id, line, round_even((quantity::DECIMAL(18,3) * rate::DECIMAL(18,2))::DECIMAL(36,5), 2)::DOUBLE AS value FROM ({SAID})")(
    lambda s, d: Ledger(s, d).lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), spoken.value((F.col("l_quantity").cast("decimal(10,0)") * F.lit("0.125").cast("decimal(4,3)")).cast("decimal(16,3)"), F.col("l_extendedprice").cast("decimal(16,2)")).cast("double").alias("value")))
register("spoken_numbers", "SELECT p_partkey AS id, (800 + p_partkey % 10 + 10)::BIGINT AS concatenated, (3 * 1000 + 20 + p_partkey % 10)::BIGINT AS scaled FROM part")(
    lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), spoken.number(F.concat(F.lit("eight "), F.element_at(F.array(*map(F.lit, spoken.TEENS)), (F.col("p_partkey") % 10 + 1).cast("int")))).alias("concatenated"), spoken.number(F.concat(F.lit("three thousand twenty "), F.element_at(F.array(*map(F.lit, spoken.DIGITS)), (F.col("p_partkey") % 10 + 1).cast("int")))).alias("scaled")))
register("clip_labels", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'confirmed' ELSE 'corrected' END AS label FROM conversations")(
    lambda s, d: Ledger(s, d).conversations.select("conv_id", "turn", spoken.label(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), F.expr("IF(turn % 2 = 0, trim(BOTH ' \\n\\t' FROM text), concat('x', text))")).alias("label")))

DEALS = "concat('C', p_partkey % 90 + 10, ' se V', p_partkey % 80 + 10, ' ko ', p_size % 90 + 10, ' bori kaju ', 1000 + p_partkey % 900, ' mein')"
register("spoken_trades", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Micron' ELSE 'C' || (p_partkey % 90 + 10) END AS seller, CASE WHEN p_partkey % 3 = 0 THEN 'Virat Agro' ELSE 'V' || (p_partkey % 80 + 10) END AS buyer,
  CASE WHEN p_partkey % 3 = 0 THEN 'Almond' ELSE 'Cashew' END AS goods, CASE WHEN p_partkey % 3 = 0 THEN 33 ELSE p_size % 90 + 10 END::DOUBLE AS quantity, 'BAGS' AS uom, CASE WHEN p_partkey % 3 = 0 THEN 1250 ELSE 1000 + p_partkey % 900 END::DOUBLE AS rate FROM part""")(
    lambda s, d: sentences.deals(Ledger(s, d).part.selectExpr("p_partkey AS id", f"IF(p_partkey % 3 = 0, 'haan ji, from Micron to Virat Agro thirty-three bags badam rate twelve fifty', {DEALS}) AS text")).select("id", "seller", "buyer", "goods", "quantity", "uom", "rate"))

# --- A bill's life --------------------------------------------------------------------------------------------------

FILES = "CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' WHEN 2 THEN '.png' ELSE '.pdf' END"
register("upload_outcomes", f"""WITH f AS (SELECT doc_id AS id, sha256(text) AS sha256, lower({FILES}) AS suffix, CASE WHEN coalesce(strlen(text), 0) = 0 THEN 'empty' WHEN strlen(text) > 4000 THEN 'too_large' WHEN doc_id % 5 = 1 THEN 'bad_suffix' END AS refused FROM documents),
o AS (SELECT *, coalesce(refused, CASE WHEN row_number() OVER (PARTITION BY sha256, CASE WHEN refused IS NOT NULL THEN id END ORDER BY id) > 1 THEN 'duplicate' ELSE 'stored' END) AS outcome FROM f)
SELECT id, sha256, outcome, CASE WHEN outcome = 'stored' THEN 'files/' || sha256[1:2] || '/' || sha256[3:4] || '/' || sha256 || suffix END AS path FROM o""")(
    lambda s, d: lifecycle.arrivals(Ledger(s, d).documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.expr(FILES)).alias("filename"), F.encode("text", "UTF-8").alias("content")), 4000))
register("page_texts", "SELECT conv_id, string_agg('--- page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY 1")(
    lambda s, d: lifecycle.page_texts(Ledger(s, d).conversations, "conv_id", "turn", "text"))
register("bill_rows", B + "SELECT invoice_id, to_json(list({'line_no': line_no, 'product_id': product_id} ORDER BY line_no))::VARCHAR AS json FROM lines GROUP BY 1")(
    lambda s, d: lifecycle.nested(Ledger(s, d).lines.select("invoice_id", F.col("line_no").cast("long").alias("line_no"), "product_id"), "invoice_id", "line_no", ["product_id"]))
register("bill_rows_flat", B + "SELECT invoice_id, line_no, product_id FROM lines")(lambda s, d: lifecycle.unnested(QUERIES["bill_rows"](s, d), "invoice_id", "line_no: bigint, product_id: bigint"))
register("derived_totals", B + """SELECT id, CASE WHEN id % 3 = 0 THEN t ELSE taxable_value END::DOUBLE AS taxable_value, CASE WHEN id % 5 = 0 THEN q ELSE total_quantity END::DOUBLE AS total_quantity, CASE WHEN n = 1 THEN u END AS uom
FROM invoices LEFT JOIN (SELECT invoice_id, sum(taxable_amount) AS t, sum(quantity) AS q, count(DISTINCT CASE WHEN product_id % 10 = 0 THEN 'BAG' ELSE 'KGS' END) AS n, min(CASE WHEN product_id % 10 = 0 THEN 'BAG' ELSE 'KGS' END) AS u FROM lines GROUP BY 1) ON id = invoice_id""")(
    lambda s, d: lifecycle.filled(Ledger(s, d).invoices.selectExpr("id", "IF(id % 3 = 0, NULL, taxable_value) AS taxable_value", "IF(id % 5 = 0, NULL, total_quantity) AS total_quantity", "CAST(NULL AS STRING) AS uom"), Ledger(s, d).plain_lines.selectExpr("invoice_id", "taxable_amount", "quantity", "IF(product_id % 10 = 0, 'BAG', 'KGS') AS uom")).withColumns({c: F.col(c).cast("double") for c in ("taxable_value", "total_quantity")}))
register("charge_totals", B + """SELECT invoice_id, coalesce(-sum(taxable_amount) FILTER (line_no % 5 = 0), 0)::DOUBLE AS discounts, coalesce(sum(taxable_amount) FILTER (line_no % 5 = 1), 0)::DOUBLE AS round_off,
  coalesce(sum(taxable_amount) FILTER (line_no % 5 = 2), 0)::DOUBLE AS collected, coalesce(sum(taxable_amount) FILTER (line_no % 5 > 2), 0)::DOUBLE AS additions FROM lines GROUP BY 1""")(
    lambda s, d: lifecycle.charge_totals(Ledger(s, d).lines.selectExpr("invoice_id", "element_at(array('discount', 'round_off', 'tcs', 'freight', 'labour'), CAST(line_no % 5 + 1 AS INT)) AS kind", "taxable_amount AS amount")).selectExpr("invoice_id", *(f"CAST({c} AS DOUBLE) AS {c}" for c in ("discounts", "round_off", "collected", "additions"))))


def edits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bills = Ledger(s, d).invoices.select("id", "invoice_number", "status")
    asked = bills.selectExpr("id", "inline(filter(array(IF(id % 7 = 0, struct('invoice_number' AS field, 'EDIT' AS value), NULL), IF(id % 14 = 0, struct('status' AS field, 'confirmed' AS value), NULL), IF(id % 5 = 0, struct('id' AS field, '1' AS value), NULL)), x -> x IS NOT NULL))")
    return lifecycle.edited(bills, asked, ["invoice_number", "status"])


register("edited_bills", B + "SELECT id, CASE WHEN id % 7 = 0 THEN 'EDIT' ELSE invoice_number END AS invoice_number, CASE WHEN id % 14 = 0 THEN 'confirmed' ELSE status END AS status FROM invoices")(lambda s, d: edits(s, d)[0])
register("edit_log", B + "SELECT id, 'invoice_number' AS field, invoice_number AS before, 'EDIT' AS after FROM invoices WHERE id % 7 = 0 UNION ALL SELECT id, 'status', status, 'confirmed' FROM invoices WHERE id % 14 = 0 AND status <> 'confirmed'")(lambda s, d: edits(s, d)[1])
register("confirm_gate", f"WITH f AS ({ORACLES['flags_totals']}) SELECT o_orderkey AS id, o_orderkey NOT IN (SELECT invoice_id FROM f WHERE severity = 'error' AND invoice_id % 2 <> 0) OR o_orderkey % 10 = 1 AS ok FROM orders")(
    lambda s, d: lifecycle.confirmable(Ledger(s, d).invoices, rules.totals(extra(s, d)).withColumn("resolved", F.col("invoice_id") % 2 == 0), F.col("id") % 10 == 1))
register("field_scores", B + """SELECT field, count(*) FILTER (ok) AS hits, count(*) AS total, round(100 * count(*) FILTER (ok) / count(*), 1) AS percent FROM (
  SELECT 'grand_total' AS field, id % 50 <> 0 AND id % 3 < 2 AS ok FROM invoices UNION ALL SELECT 'invoice_number', id % 50 <> 0 FROM invoices UNION ALL SELECT 'financial_year', id % 50 <> 0 AND id % 9 <> 0 FROM invoices) GROUP BY 1""")(
    lambda s, d: lifecycle.scores((v := Ledger(s, d).invoices.select("id", "grand_total", "invoice_number", "financial_year")), v.where("id % 50 <> 0").selectExpr("id", "grand_total + id % 3 AS grand_total", "lower(replace(invoice_number, '-', ' ')) AS invoice_number", "IF(id % 9 = 0, 'x', financial_year) AS financial_year"), {"grand_total": "money", "invoice_number": "text", "financial_year": "exact"}))
register("supply_types", B + EXTRA + "SELECT id, CASE WHEN seller_state = buyer_state THEN 'intra' WHEN seller_state <> buyer_state THEN 'inter' END AS supply_type FROM extra")(lambda s, d: extra(s, d).select("id", lifecycle.supply_type(F.col("seller_state"), F.col("buyer_state")).alias("supply_type")))
register("pans", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'ABCDE' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || 'F' END AS pan FROM part")(
    lambda s, d: Ledger(s, d).part.select(F.col("p_partkey").alias("id"), lifecycle.pan(C.alnum_upper(F.expr("concat('27 abcd', IF(p_partkey % 3 = 1, '1', 'e'), lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), 'f1z', IF(p_partkey % 3 = 2, '', '5'))"))).alias("pan")))


def page_cells(s: SparkSession, d: str) -> DataFrame:
    """Names, brands and types of parts laid out three words a line, the second and third close to each other."""
    said = Ledger(s, d).part.selectExpr("p_partkey AS doc", "posexplode(split(concat_ws(' ', p_name, p_brand, p_type), ' ')) AS (k, text)")
    words = said.selectExpr("doc", "1 AS page", "CAST(element_at(array(0, 40, 70), k % 3 + 1) AS DOUBLE) AS x0", "CAST(element_at(array(20, 60, 90), k % 3 + 1) AS DOUBLE) AS x1", "CAST(k DIV 3 * 12 + k % 2 * 2 AS DOUBLE) AS y", "text")
    heads = words.select("doc", "page").distinct().selectExpr("doc", "page", "inline(array(struct('A' AS name, 0D AS x0, 20D AS x1), struct('B' AS name, 40D AS x0, 90D AS x1)))")
    return layout.in_columns(layout.cells(layout.lines(words)), heads).select("doc", "line", "cell", "text", F.col("column").alias("head"))


register("page_cells", """WITH p AS (SELECT p_partkey AS doc, string_split(concat_ws(' ', p_name, p_brand, p_type), ' ') AS ws FROM part), w AS (SELECT doc, ws, unnest(range(0, len(ws))) AS k FROM p)
SELECT doc, k // 3 AS line, (k % 3 > 0)::BIGINT AS cell, string_agg(ws[k + 1], ' ' ORDER BY k) AS text, CASE WHEN k % 3 = 0 THEN 'A' ELSE 'B' END AS head FROM w GROUP BY doc, k // 3, k % 3 > 0, CASE WHEN k % 3 = 0 THEN 'A' ELSE 'B' END""")(page_cells)


def printed_bills(s: SparkSession, d: str) -> DataFrame:
    """Bills as positioned words, a page each: a heading, the goods, packages beneath each third one, a total and its words."""
    word = lambda x0, x1, y, text: f"struct(CAST({x0} AS DOUBLE) AS x0, CAST({x1} AS DOUBLE) AS x1, CAST({y} AS DOUBLE) AS y, CAST({text} AS STRING) AS text)"
    lines = Ledger(s, d).lines.selectExpr("invoice_id AS doc", "line_no", "product_id", "quantity", "taxable_amount")
    heading = [word(0, 8, 0, "'Sl'"), word(0, 10, 8, "'No.'"), word(30, 60, 0, "'Particulars'"), word(200, 240, 0, "'Quantity'"), word(380, 420, 0, "'Amount'")]
    goods = [word(0, 6, "30 * line_no", "line_no"), word(30, 70, "30 * line_no", "concat('P', product_id)"), word(200, 222, "30 * line_no", "quantity"), word(226, 240, "30 * line_no", "'KGS'"), word(380, 420, "30 * line_no", "taxable_amount")]
    packages = "IF(line_no % 3 = 0, array(" + word(30, 40, "30 * line_no + 10", "line_no") + ", " + word(42, 60, "30 * line_no + 10", "'Bags'") + "), array())"
    total = [word(30, 50, "30 * n + 30", "'Grand'"), word(52, 70, "30 * n + 30", "'Total'"), word(380, 420, "30 * n + 30", "t"), word(30, 60, "30 * n + 60", "'Amount in words :'"), word(70, 200, "30 * n + 60", "concat('Nine Lakh and ', n, ' Thousand Only')")]
    ends = lines.groupBy("doc").agg(F.max("line_no").alias("n"), F.sum("taxable_amount").alias("t"))
    words = lines.selectExpr("doc", f"inline(concat(array({', '.join(goods)}), {packages}))").unionByName(ends.selectExpr("doc", f"inline(array({', '.join(heading + total)}))"))
    return tables.page_by_line(words.selectExpr("doc", "1 AS page", "x0", "x1", "y", "text"))


def goods_table(s: SparkSession, d: str) -> DataFrame:
    bills = printed_bills(s, d)
    table = tables.rows(bills, tables.headings(bills))
    return table.select("doc", F.col("row").alias("line_no"), "serial", "quantity", "amount", "class", tables.beneath(F.col("description"), F.col("item_remarks"), F.col("extra")).alias("b")).select("*", "b.description", "b.bags").drop("b")


register("goods_table", B + "SELECT invoice_id AS doc, line_no, line_no::VARCHAR AS serial, quantity::VARCHAR || ' KGS' AS quantity, taxable_amount::VARCHAR AS amount, 'goods' AS class, 'P' || product_id AS description, CASE WHEN line_no % 3 = 0 THEN line_no END::DOUBLE AS bags FROM lines")(goods_table)
register("printed_totals", B + "SELECT invoice_id AS doc, sum(taxable_amount)::DOUBLE AS grand_total, 'Nine Lakh and ' || max(line_no) || ' Thousand Only' AS words FROM lines GROUP BY 1")(
    lambda s, d: tables.totals(b := printed_bills(s, d)).where("field = 'grand_total'").select("doc", F.col("value").cast("double").alias("grand_total")).join(tables.in_words(b), "doc", "left"))
register("tax_table", "SELECT o_orderkey AS doc, lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS hsn, 1000.0::DOUBLE AS taxable_value, CASE WHEN o_orderkey % 2 = 0 THEN 'cgst|sgst' ELSE 'igst' END AS heads, CASE WHEN o_orderkey % 2 = 0 THEN 50.0 ELSE 180.0 END::DOUBLE AS tax FROM orders")(
    lambda s, d: tables.tax_rows(tables.page_by_line(Ledger(s, d).orders.selectExpr("o_orderkey AS doc", "1 AS page", """inline(transform(split(IF(o_orderkey % 2 = 0, concat('HSN Taxable CGST SGST/UTGST Total|', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), ' 1,000.00 2.5 25.00 2.5 25.00 50.00'),
      concat('HSN Taxable IGST Total|', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), ' 1,000.00 18 180.00 180.00')), '[|]'), (t, i) -> struct(0D AS x0, 90D AS x1, i * 20D AS y, t AS text)))""")
      .selectExpr("doc", "page", "posexplode(split(text, ' ')) AS (k, text)", "y").selectExpr("doc", "page", "k * 40D AS x0", "k * 40D + 30 AS x1", "y", "text")))
    .select("doc", "hsn", F.col("taxable_value").cast("double").alias("taxable_value"), F.array_join(F.transform("taxes", lambda t: t["head"]), "|").alias("heads"), F.aggregate("taxes", F.lit(0).cast("decimal(38,6)"), lambda a, t: (a + t["amount"]).cast("decimal(38,6)")).cast("double").alias("tax")))


def labelled_values(s: SparkSession, d: str) -> DataFrame:
    """A number under its label, the broker to the right of theirs, a carrier's label with nothing, for each order."""
    word = lambda x0, x1, y, text: f"struct({x0}D AS x0, {x1}D AS x1, {y}D AS y, {text} AS text)"
    words = [word(0, 28, 0, "'Invoice'"), word(30, 40, 0, "'No.'"), word(100, 130, 0, "'Dated'"), word(0, 40, 12, "concat('NGA/', o_orderkey)"), word(100, 140, 12, "date_format(o_orderdate, 'd-MMM-yy')")]
    words += [word(0, 40, 40, "'Broker'"), word(42, 48, 40, "':'"), word(52, 90, 40, "concat('C', o_custkey)"), word(200, 240, 40, "'Destination'"), word(244, 280, 40, "o_orderpriority"), word(0, 90, 60, "'Transporter Name'"), word(0, 90, 72, "'Vehicle No'")]
    page = tables.page_by_line(Ledger(s, d).orders.selectExpr("o_orderkey AS doc", "1 AS page", f"inline(array({', '.join(words)}))"))
    return labels.values(page, {"number": ("invoice no",), "date": ("dated",), "broker": ("broker name", "broker"), "to": ("destination",), "carrier": ("transporter name",)})


register("labelled_values", """SELECT o_orderkey AS doc, 'number' AS field, 'NGA/' || o_orderkey AS value FROM orders UNION ALL SELECT o_orderkey, 'date', strftime(o_orderdate, '%-d-%b-%y') FROM orders
UNION ALL SELECT o_orderkey, 'broker', 'C' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 'to', o_orderpriority FROM orders""")(labelled_values)
register("snapped_names", "SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 3 = 0 THEN 'zzzz' ELSE c_mktsegment || ' Mart' END AS name FROM customer")(
    lambda s, d: matching.snapped(Ledger(s, d).customer.selectExpr("c_custkey AS ask_id", "IF(c_custkey % 3 = 0, 'zzzz', concat(lower(left(c_mktsegment, length(c_mktsegment) - 1)), 'mart')) AS heard"), Ledger(s, d).customer.selectExpr("concat(c_mktsegment, ' Mart') AS name")).select("ask_id", "name"))


def addressed_bills(s: SparkSession, d: str) -> DataFrame:
    """Letterheads of nations over two parties side by side, a page a customer."""
    word = lambda x0, x1, y, text: f"struct({x0}D AS x0, {x1}D AS x1, {y}D AS y, {text} AS text)"
    words = [word(0, 40, 0, "'TAX'"), word(42, 80, 0, "'INVOICE'"), word(0, 60, 12, "concat('Mill', c_nationkey)"), word(250, 290, 12, "'Dated'"), word(0, 60, 24, "'APMC Yard'"), word(250, 290, 24, "'1-Jul-26'")]
    words += [word(0, 20, 40, "'Bill'"), word(22, 30, 40, "'to'"), word(250, 270, 40, "'Shipped'"), word(272, 280, 40, "'to'"), word(0, 90, 52, "c_name"), word(250, 290, 52, "c_mktsegment"), word(0, 20, 64, "CAST(c_nationkey AS STRING)"), word(22, 60, 64, "'Park'"), word(250, 290, 64, "'Pune'")]
    return tables.page_by_line(Ledger(s, d).customer.selectExpr("c_custkey AS doc", "1 AS page", f"inline(array({', '.join(words)}))"))


register("party_blocks", """SELECT c_custkey AS doc, 'buyer' AS role, c_name AS name, NULL::VARCHAR AS gstin, c_nationkey || ' Park' AS lines FROM customer
UNION ALL SELECT c_custkey, 'consignee', c_mktsegment, NULL, 'Pune' FROM customer""")(lambda s, d: blocks.parties(addressed_bills(s, d)).select("doc", "role", "name", "gstin", F.array_join("lines", "|").alias("lines")))
register("letterheads", "SELECT c_custkey AS doc, 'Mill' || c_nationkey AS name, 'TAX INVOICE|APMC Yard' AS lines FROM customer")(lambda s, d: blocks.letterheads(addressed_bills(s, d)).select("doc", "name", F.array_join("lines", "|").alias("lines")))


def ingest_stream(s: SparkSession, d: str) -> DataFrame:
    """Documents as arriving files, streamed into the shared folder; each content once."""
    root = f"{scratch(s)}/ingest-{uuid.uuid4()}"
    docs = s.readStream.schema(bridge.read(s, d, "documents").schema).parquet(f"{d}/documents[.]parquet")  # as a pattern, since a stream takes no single file
    files = docs.selectExpr("concat('d', doc_id, '.pdf') AS filename", "encode(coalesce(text, ''), 'UTF-8') AS content", "TIMESTAMP '2024-01-01' AS arrived")
    jobs.ingest(files, f"{root}/out", f"{root}/state").awaitTermination()
    return s.read.parquet(f"{root}/out").select("sha256", "path")


register("ingest_stream", "SELECT DISTINCT sha256(coalesce(text, '')) AS sha256, 'files/' || sha256(coalesce(text, ''))[1:2] || '/' || sha256(coalesce(text, ''))[3:4] || '/' || sha256(coalesce(text, '')) AS path FROM documents")(ingest_stream)

# --- Print ----------------------------------------------------------------------------------------------------------


def of_part(s: SparkSession, d: str, **columns: Column | str) -> DataFrame:
    return Ledger(s, d).part.select(F.col("p_partkey").alias("id"), *(F.expr(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()))


register("printed_quantities", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN -1 ELSE 1 END * (4000 + p_size)::DOUBLE AS number, CASE p_partkey % 4 WHEN 1 THEN NULL ELSE 'KGS' END AS unit FROM part")(
    lambda s, d: of_part(s, d, q=P.quantity(F.expr("concat(' ', element_at(array('4,0', '4,0', '-4,0', 'kgs '), CAST(p_partkey % 4 + 1 AS INT)), IF(p_partkey % 4 = 3, '', concat(lpad(CAST(p_size AS STRING), 2, '0'), '.000')), IF(p_partkey % 4 = 1, '', ' kgs'))"))).select("id", "q.*"))
register("document_types", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'credit_note' WHEN 1 THEN 'proforma_invoice' ELSE 'tax_invoice' END AS type FROM part")(
    lambda s, d: of_part(s, d, type=P.document_type(F.expr("concat(p_name, repeat('\\n', IF(p_partkey % 4 = 2, 6, 3)), element_at(array('CREDIT Note', 'Proforma of a sale', 'Debit Note', 'Bill'), CAST(p_partkey % 4 + 1 AS INT)))"))))
register("broker_names", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE 'NILESH BHAI C' || p_size END AS broker FROM part")(
    lambda s, d: of_part(s, d, broker=P.broker(F.expr("IF(p_partkey % 3 = 2, ' .-', concat(' NILESH  BHAI C', p_size, IF(p_partkey % 3 = 0, ' 0.5% each', ' :')))"))))
register("found_identifiers", "SELECT p_partkey AS id, 'p' || p_partkey || '@mill.in' AS email, 'ABCDE' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || 'F' AS pan, 400000 + p_partkey % 1000 || '' AS pin, CASE WHEN p_partkey % 2 = 0 THEN sha256(p_name) END AS irn FROM part")(
    lambda s, d: of_part(s, d, text="concat('mail p', p_partkey, '@mill.in, PAN ABCDE', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), 'F;Pune ', 400000 + p_partkey % 1000, '\\nIRN ', left(sha2(p_name, 256), 40), '\\n', IF(p_partkey % 2 = 0, right(sha2(p_name, 256), 24), ''))")
    .select("id", *(F.get(P.found(F.col("text"), k), F.lit(0)).alias(k) for k in ("email", "pan", "pin")), P.reference_number(F.col("text")).alias("irn")))
STRFTIMES = ("%d-%b-%y", "%d-%b-%Y", "%d/%m/%Y", "%d/%m/%y", "%d-%m-%Y", "%d.%m.%Y", "%d %b %Y", "%Y-%m-%d")
register("date_forms", f"SELECT o_orderkey AS id, {" || '|' || ".join(f"strftime(o_orderdate, '{f}')" for f in STRFTIMES)} AS forms FROM orders")(
    lambda s, d: Ledger(s, d).orders.select(F.col("o_orderkey").alias("id"), F.array_join(P.date_forms(F.col("o_orderdate").cast("date")), "|").alias("forms")))
register("number_forms", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN p_size || '.50|' || p_size || '.500' ELSE p_size || '.00|' || p_size || '.000|' || p_size END AS forms FROM part")(
    lambda s, d: of_part(s, d, forms=F.array_join(P.number_forms(F.expr("CAST(p_size + p_partkey % 2 * 0.5 AS DECIMAL(18,3))")), "|")))
register("request_costs", "SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN (event_id * 5.0 + 200 * 25.0) / 1e6 WHEN 1 THEN (event_id * 1.0 + 200 * 5.0) / 1e6 END * CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1 END AS usd FROM events")(
    lambda s, d: Ledger(s, d).events.select(F.col("event_id").alias("id"), P.cost({"large": (5.0, 25.0), "small": (1.0, 5.0)}, F.expr("element_at(array('large', 'small', 'other'), CAST(user_id % 3 + 1 AS INT))"), F.col("event_id"), F.lit(200), F.col("event_id") % 2 == 0).alias("usd")))
register("settled_readings", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Cashew' ELSE 'Kaju W240' END AS goods, CASE WHEN p_partkey % 3 = 0 THEN 'Micron' ELSE 'C31' END AS seller, CASE WHEN p_partkey % 5 <> 0 THEN p_size::VARCHAR END AS quantity,
  CASE WHEN p_partkey % 5 <> 0 THEN 'rules' ELSE 'unread' END AS quantity_by, CASE WHEN p_partkey % 5 = 0 OR p_size <> 10 THEN '10' END AS model_said FROM part""")(
    lambda s, d: of_part(s, d, goods=P.settled("goods", F.lit("Cashew"), F.lit("Kaju W240"), F.expr("p_partkey % 2 = 0")), seller=P.settled("seller", F.expr("IF(p_partkey % 3 = 0, NULL, 'C31')"), F.lit("Micron"), F.lit(None)), q=P.settled("quantity", F.expr("IF(p_partkey % 5 = 0, NULL, p_size)"), F.lit(10), F.lit(None)))
    .selectExpr("id", "goods.value AS goods", "seller.value AS seller", "q.value AS quantity", "q.read_by AS quantity_by", "q.model_said"))
