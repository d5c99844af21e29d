"""Checks of bills: every rule is an expression over a bill enriched once; flags are one array, exploded.

A bill carries sums of its lines, charges and tax rows, made by one aggregate each, so no rule scans for itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.cleaning import gstin_problems, hsn, words_amount

ERROR, WARNING = "error", "warning"
#: Rupees that a total and a line may be off.
TOLERANCE, LINE_TOLERANCE = 1, 2


def flag(when: Column, rule: str, severity: str | Column, path: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(F.lit(rule).alias("rule"), lit(severity).alias("severity"), lit(path).alias("field_path")))


def emitted(bills: DataFrame, flags: list[Column]) -> DataFrame:
    return bills.select(F.col("id").alias("invoice_id"), F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("f")).select("invoice_id", "f.*")


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("decimal(30,6)")


def required(bills: DataFrame) -> DataFrame:
    missing = [flag(F.col(c).isNull() | (F.col(c).cast("string") == ""), "missing_required_field", ERROR, c) for c in ("invoice_number", "invoice_date", "grand_total", "seller_id", "buyer_id")]
    return emitted(bills, [*missing, flag(F.coalesce("n_lines", F.lit(0)) == 0, "no_line_items", ERROR, "lines")])


def identities(bills: DataFrame, roles: tuple[str, ...] = ("seller", "buyer")) -> DataFrame:
    """Problems of the parties' cleaned taxpayer numbers ({role}_gstin), and states that don't fit them."""
    rows = []
    for role in roles:
        g = F.col(f"{role}_gstin")
        problems = bills.select(F.col("id").alias("invoice_id"), F.explode(gstin_problems(g)).alias("p"))
        rows.append(problems.select("invoice_id", F.lit("gstin_invalid").alias("rule"), F.when(F.col("p") == "checksum", ERROR).otherwise(WARNING).alias("severity"), F.lit(f"{role}.gstin").alias("field_path")))
        rows.append(emitted(bills, [flag((F.col(f"{role}_state") != F.substring(g, 1, 2)), "state_code_mismatch", WARNING, f"{role}.state_code")]))
    return reduce(DataFrame.unionByName, rows)


def line_arithmetic(lines: DataFrame) -> DataFrame:
    """quantity x rate less the discount against the amount; lines with one of them missing aren't judged."""
    gross = F.col("quantity").cast("decimal(18,3)") * F.col("rate").cast("decimal(18,4)")
    pct = F.nullif(F.col("discount_pct"), F.lit(0)).cast("decimal(9,4)")
    gross = gross.cast("decimal(27,7)")
    expected = F.when(pct.isNotNull(), gross - (gross * pct * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(30,8)")).otherwise(gross - F.abs(zero("discount_amount")))
    off = F.abs(expected - F.col("taxable_amount"))
    return lines.where(off > LINE_TOLERANCE).select("invoice_id", F.lit("line_arithmetic").alias("rule"), F.lit(WARNING).alias("severity"), F.concat(F.lit("lines."), F.col("line_no").cast("string"), F.lit(".taxable_amount")).alias("field_path"))


def gap(target: Column, arrangements: list[Column]) -> Column:
    return F.least(*(F.abs(a - target) for a in arrangements))


def totals(bills: DataFrame) -> DataFrame:
    """Lines against the taxable value, the parts against the grand total, quantities against the printed one.

    Sums by kind of charge: discounts (negative), additions, charge_round, charge_tcs; a total is off only if no usual
    arrangement of the parts gives it.
    """
    lines, disc, add = zero("lines_sum"), zero("discounts"), zero("additions")
    taxable, grand = F.col("taxable_value").cast("decimal(30,6)"), F.col("grand_total").cast("decimal(30,6)")
    base = F.coalesce(taxable, lines + disc)
    taxes = zero("cgst_amount") + zero("sgst_amount") + zero("igst_amount") + zero("cess_amount")
    tcs = F.coalesce(F.nullif(F.col("tcs_amount"), F.lit(0)).cast("decimal(30,6)"), zero("charge_tcs"))
    rounding, other = (F.coalesce(F.col(c).cast("decimal(30,6)"), zero(d)) for c, d in (("round_off", "charge_round"), ("other_charges", "additions")))
    return emitted(bills, [
        flag((F.col("n_lines") > 0) & (gap(taxable, [lines, lines + disc, lines + disc + add, lines + add]) > TOLERANCE), "taxable_value_mismatch", ERROR, "taxable_value"),
        flag(gap(grand, [base + taxes + other + tcs + rounding, base + taxes + tcs + rounding, base + taxes + other + tcs]) > TOLERANCE, "grand_total_mismatch", ERROR, "grand_total"),
        flag((F.col("n_lines") > 0) & (F.abs(zero("lines_quantity") - F.col("total_quantity")) > F.lit("0.01").cast("decimal(3,2)")), "quantity_mismatch", WARNING, "total_quantity"),
    ])


def tax_rows(rows: DataFrame, bills: DataFrame) -> DataFrame:
    """Each head of each tax row against base x rate, and the rows' sums against the header."""
    heads = ("cgst", "sgst", "igst")
    each = rows.select("invoice_id", "row_no", "taxable_value", F.explode(F.array(*(F.struct(F.lit(h).alias("head"), F.col(f"{h}_rate").cast("decimal(9,4)").alias("rate"), F.col(f"{h}_amount").cast("decimal(18,2)").alias("amount")) for h in heads))).alias("h")).select("*", "h.*")
    due = F.col("taxable_value").cast("decimal(18,2)") * F.col("rate") * F.lit("0.01").cast("decimal(3,2)")
    wrong = each.where((F.col("rate") != 0) & (F.abs(due.cast("decimal(30,6)") - F.col("amount")) > TOLERANCE))
    computed = wrong.select("invoice_id", F.lit("tax_computation").alias("rule"), F.lit(WARNING).alias("severity"), F.concat(F.lit("tax_rows."), F.col("row_no").cast("string"), F.lit("."), F.col("head")).alias("field_path"))
    sums = rows.groupBy("invoice_id").agg(*(F.sum(f"{h}_amount").alias(f"{h}_rows") for h in heads))
    both = bills.join(sums, F.col("id") == F.col("invoice_id")).drop("invoice_id")
    return computed.unionByName(emitted(both, [flag(F.abs(F.col(f"{h}_amount") - zero(f"{h}_rows")) > TOLERANCE, "tax_summary_mismatch", WARNING, f"{h}_amount") for h in heads]))


def words(bills: DataFrame) -> DataFrame:
    return emitted(bills, [flag(F.abs(words_amount(F.col("amount_in_words")).cast("decimal(30,2)") - F.col("grand_total")) > TOLERANCE, "amount_in_words_mismatch", ERROR, "amount_in_words")])


def supply(bills: DataFrame) -> DataFrame:
    """Within a state CGST and SGST are due, and equal; across states IGST. The consignee's state counts before the buyer's."""
    seller, buyer = F.nullif(F.col("seller_state"), F.lit("")), F.nullif(F.coalesce("consignee_state", "buyer_state"), F.lit(""))
    intra, inter, two = seller == buyer, seller != buyer, zero("cgst_amount") + zero("sgst_amount")
    return emitted(bills, [
        flag(intra & (zero("igst_amount") > TOLERANCE), "supply_type_mismatch", ERROR, "igst_amount"),
        flag(inter & (two > TOLERANCE), "supply_type_mismatch", ERROR, "cgst_amount"),
        flag(intra & (F.abs(F.col("cgst_amount") - F.col("sgst_amount")) > TOLERANCE), "cgst_sgst_unequal", WARNING, "sgst_amount"),
    ])


def formats(bills: DataFrame, as_of: str) -> DataFrame:
    day = F.col("invoice_date")
    return emitted(bills, [
        flag(F.abs(F.col("round_off")) >= 1, "round_off_out_of_range", WARNING, "round_off"),
        flag(day > F.date_add(F.lit(as_of).cast("date"), 1), "date_in_future", WARNING, "invoice_date"),
        flag(day < F.lit("2000-01-01").cast("date"), "date_implausible", WARNING, "invoice_date"),
        flag(F.col("due_date") < day, "due_before_invoice", WARNING, "due_date"),
        flag((F.col("irn") != "") & (F.length("irn") != 64), "irn_length", WARNING, "irn"),
        flag((F.col("eway_bill_no") != "") & (F.length(F.trim("eway_bill_no")) != 12), "eway_bill_length", WARNING, "eway_bill_no"),
    ])


def hsn_format(lines: DataFrame) -> DataFrame:
    return lines.where(~F.length(hsn(F.col("hsn"))).isin(4, 6, 8)).select("invoice_id", F.lit("hsn_format").alias("rule"), F.lit(WARNING).alias("severity"), F.concat(F.lit("lines."), F.col("line_no").cast("string"), F.lit(".hsn")).alias("field_path"))


def confidence(bills: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return emitted(bills, [flag(c < 0.85, "low_confidence", F.when(c < 0.6, ERROR).otherwise(WARNING), "overall_confidence")])


def completeness(bills: DataFrame, lines: DataFrame) -> DataFrame:
    """Fields the reading says it hasn't captured, a waybill without a transporter, a broker who isn't known, lines
    without a description."""
    gone = bills.select("id", F.explode(F.filter("unmapped_fields", lambda x: x["section"] == "not_captured")).alias("u")).select(F.col("id").alias("invoice_id"), F.lit("field_not_captured").alias("rule"), F.lit(WARNING).alias("severity"), F.col("u.label").alias("field_path"))
    own = emitted(bills, [flag((F.col("eway_bill_no") != "") & F.col("transporter_id").isNull(), "transporter_missing", WARNING, "transporter_id"), flag((F.trim("broker_name_raw") != "") & F.col("broker_id").isNull(), "broker_unresolved", WARNING, "broker_id")])
    blank = lines.where(F.trim(F.coalesce("description", F.lit(""))) == "").select("invoice_id", F.lit("line_without_description").alias("rule"), F.lit(WARNING).alias("severity"), F.concat(F.lit("lines."), F.col("line_no").cast("string"), F.lit(".description")).alias("field_path"))
    return gone.unionByName(own).unionByName(blank)


def duplicates(bills: DataFrame) -> DataFrame:
    """Later bills of one seller, number and year; years that are null are one year."""
    by = Window.partitionBy("seller_id", "invoice_number", "financial_year").orderBy("id")
    rows = bills.where(F.col("seller_id").isNotNull() & (F.col("invoice_number") != ""))
    return rows.withColumn("n", F.row_number().over(by)).withColumn("first_id", F.first("id").over(by)).where("n > 1").select("id", "first_id")


def first_bills(bills: DataFrame) -> DataFrame:
    """Each seller's first bill: a minimum that tasks combine before anything is shuffled."""
    return bills.where("seller_id is not null").groupBy("seller_id").agg(F.min("id").alias("id"))


def worst(flags: DataFrame) -> DataFrame:
    rank = F.max(F.when(F.col("severity") == ERROR, 2).otherwise(1))
    return flags.groupBy("invoice_id").agg(F.when(rank == 2, ERROR).otherwise(WARNING).alias("severity"), F.count("*").alias("n_flags"))


def statuses(bills: DataFrame, flags: DataFrame) -> DataFrame:
    """Status after checking: confirmed stays; else needs_review with any open flag, extracted without."""
    open_ = flags.select("invoice_id").distinct()
    after = F.when(F.col("status") == "confirmed", F.col("status")).when(F.col("invoice_id").isNotNull(), "needs_review").otherwise("extracted")
    return bills.join(open_, F.col("id") == F.col("invoice_id"), "left").select("id", F.col("status").alias("before"), after.alias("after"))


def carried(new: DataFrame, old: DataFrame) -> DataFrame:
    """New flags with resolved taken over from old ones of the same rule and (null-safe) field."""
    done = old.where("resolved").select(F.col("invoice_id").alias("i"), F.col("rule").alias("r"), F.col("field_path").alias("p")).distinct()
    on = (F.col("invoice_id") == F.col("i")) & (F.col("rule") == F.col("r")) & F.col("field_path").eqNullSafe(F.col("p"))
    return new.join(done, on, "left").select(*new.columns, F.col("i").isNotNull().alias("resolved"))


def differing(a: DataFrame, b: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(key, field, first, second) where two readings of a bill differ after trimming and lower-casing."""
    pack = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("x")).select(key, "x.*")
    both = pack(a, "first").join(pack(b, "second"), [key, "field"])
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return both.where(~clean(F.col("first")).eqNullSafe(clean(F.col("second"))))
