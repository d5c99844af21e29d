"""A whole bill put together out of what was read of its parts, with their order of precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import date, words_amount
from ..functions.printed import quantity as printed_quantity
from .documents import reconciled

TAXES = ("igst", "cgst", "sgst")
ZERO = "decimal(18,2)"


def routed(rows: DataFrame) -> DataFrame:
    """The rows of goods tables (bill, row_no, class, charge, text, amount and the cells of goods) by what they are: column
    `goes` is line, charge or tax; totals that only say again what others say, and charges without an amount, go.

    A discount always lowers the bill; a tax row says which tax it is in its text.
    """
    head = F.regexp_replace(F.lower("text"), r"\s+", "")
    tax = reduce(lambda a, t: F.when(head.contains(t), t).otherwise(a), ("igst", "cgst", "sgst", "cess"), F.lit(None).cast("string"))
    goes = F.when(F.col("class") == "total", None).when(F.col("class") == "tax", F.when(F.col("amount").isNotNull() & tax.isNotNull(), "tax")).when(F.col("class") == "charge", F.when(F.col("amount").isNotNull(), "charge")).otherwise("line")
    amount = F.when((F.col("class") == "charge") & (F.col("charge") == "discount"), -F.abs("amount")).otherwise(F.col("amount"))
    label = F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 1, 80), F.lit("")), "charge", F.lit("charge"))
    return rows.withColumns({"goes": goes, "amount": amount.cast(ZERO), "tax": F.when(F.col("class") == "tax", tax), "label": label, "kind": F.coalesce("charge", F.lit("other"))}).where("goes is not null")


def table_parts(rows: DataFrame) -> DataFrame:
    """One row a bill: lines and charges as arrays in the order of the table, the taxes that its rows say, and sums. A line
    without a number of its own has its place among the lines; a unit that the quantity hasn't is its own column's."""
    read = routed(rows).withColumn("q", printed_quantity(F.col("quantity")))
    unit = F.coalesce("q.unit", F.nullif(F.upper(F.trim("rate_uom")), F.lit("")))
    line = F.struct("row_no", F.col("serial").try_cast("int").alias("serial"), "description", "hsn", F.col("q.number").cast("decimal(18,3)").alias("quantity"), unit.alias("uom"), F.col("rate").try_cast("decimal(18,4)").alias("rate"), F.col("bags").try_cast("decimal(18,3)").alias("bags"), F.col("amount").alias("taxable_amount"))
    charge = F.struct("row_no", "label", "kind", "amount")
    got = read.groupBy("bill").agg(
        F.array_sort(F.collect_list(F.when(F.col("goes") == "line", line))).alias("lines"), F.array_sort(F.collect_list(F.when(F.col("goes") == "charge", charge))).alias("charges"),
        *(F.max_by("amount", F.when((F.col("goes") == "tax") & (F.col("tax") == t), F.col("row_no"))).alias(f"row_{t}") for t in TAXES),
    )
    numbered = F.transform("lines", lambda x, i: x.withField("line_no", F.coalesce(F.nullif(x["serial"], F.lit(0)), i + 1)).dropFields("row_no", "serial"))
    return got.withColumns({"lines": numbered, "charges": F.transform("charges", lambda x: x.dropFields("row_no"))})


def total_of(array: Column, value: str, kind: str = ZERO, keep: Column | None = None) -> Column:
    """The sum of a field of an array's structs, 0 for none."""
    return F.aggregate(array, F.lit(0).cast(kind), lambda a, x: (a + F.coalesce(x[value], F.lit(0)).cast(kind)).cast(kind))


def assembled(pages: DataFrame, table: DataFrame, tax_table: DataFrame, code: DataFrame, bank: DataFrame) -> DataFrame:
    """One row a bill with every header field, lines, charges and taxes. Each side is by bill; all but pages may lack one.

    pages: what is printed (values by label, parties' names and numbers, totals and the total in words, the waybill's
    number and annexure). table: table_parts(). tax_table: summary, its rows as an array, and their taxable value.
    code: what a scanned code says. bank: bank_details(). What is printed comes before what the code says; totals
    before the tax table before the sum of lines and charges; a tax's total before its row; the grand total is what
    most of code, words and print agree on.
    """
    all_ = pages.join(table, "bill", "left").join(tax_table, "bill", "left").join(code, "bill", "left").join(bank, "bill", "left")
    empty = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    some = lambda c: F.nullif(c, F.lit(0).cast("decimal(18,3)"))
    lines, charges = (F.coalesce(c, F.array().cast(table.schema[c].dataType)) for c in ("lines", "charges"))
    of_kind = lambda *kinds: F.filter(charges, lambda c: c["kind"].isin(*kinds))
    but = lambda *kinds: F.filter(charges, lambda c: ~c["kind"].isin(*kinds))
    subtotal = total_of(lines, "taxable_amount")
    rounded = F.coalesce("round_off", F.try_element_at(of_kind("round_off"), F.lit(1))["amount"]).cast(ZERO)
    extra = F.when(F.col("round_off").isNotNull() & (F.size(of_kind("round_off")) == 0), F.array(F.struct(F.lit("Round Off").alias("label"), F.lit("round_off").alias("kind"), F.col("round_off").cast(ZERO).alias("amount")))).otherwise(F.array().cast(table.schema["charges"].dataType))
    summed = F.when(F.size(lines) > 0, (subtotal + total_of(but("round_off"), "amount")).cast(ZERO))
    grand = reconciled(F.array(F.col("code_total").cast(ZERO), words_amount(F.col("total_in_words")).cast(ZERO), F.col("grand_total").cast(ZERO)))
    seller = F.coalesce("seller_gstin", "code_seller_gstin")
    buyer = F.coalesce("buyer_gstin", "code_buyer_gstin")
    consignee = F.col("consignee_gstin").isNotNull() & ~F.coalesce(F.col("consignee_gstin") == buyer, F.lit(False)) | (F.col("consignee_gstin").isNull() & F.col("consignee_name").isNotNull() & buyer.isNotNull())
    return all_.select(
        "bill", F.coalesce(empty("invoice_number"), empty("code_number")).alias("invoice_number"), F.coalesce(date(F.col("invoice_date")), date(F.col("code_date"))).alias("invoice_date"), F.coalesce(empty("irn"), empty("code_irn")).alias("irn"),
        F.when(~F.col("seller_name").contains("(cid:"), F.col("seller_name")).alias("seller_name"), seller.alias("seller_gstin"), "buyer_name", buyer.alias("buyer_gstin"), F.when(consignee, F.col("consignee_name")).alias("consignee_name"),
        empty("place_of_supply").alias("place_of_supply"), empty("payment_terms").alias("payment_terms"), empty("broker_name").alias("broker_name"), empty("remarks").alias("remarks"),
        F.coalesce(F.nullif(F.regexp_replace("eway_bill_no", r"\D", ""), F.lit("")), "annexure_eway_no").alias("eway_bill_no"),
        lines.alias("lines"), F.concat(charges, extra).alias("charges"), F.coalesce("summary", F.array().cast(tax_table.schema["summary"].dataType)).alias("tax_summary"),
        some(subtotal).cast(ZERO).alias("subtotal"), some(F.abs(total_of(F.transform(of_kind("discount"), lambda c: c.withField("amount", F.abs(c["amount"]))), "amount"))).cast(ZERO).alias("discount_total"),
        F.coalesce(F.col("taxable_value").cast(ZERO), some(F.col("summary_taxable").cast(ZERO)), summed).cast(ZERO).alias("taxable_value"),
        *(F.coalesce(some(F.col(f"{t}_amount").cast(ZERO)), F.col(f"row_{t}")).cast(ZERO).alias(f"{t}_amount") for t in TAXES),
        some(total_of(but("discount", "round_off"), "amount")).cast(ZERO).alias("other_charges"), rounded.alias("round_off"), grand.cast(ZERO).alias("grand_total"), F.col("total_in_words").alias("amount_in_words"),
        some(total_of(lines, "quantity", "decimal(18,3)")).cast("decimal(18,3)").alias("total_quantity"), F.try_element_at(F.filter(F.transform(lines, lambda x: x["uom"]), lambda u: u.isNotNull()), F.lit(1)).alias("uom"),
        some(total_of(lines, "bags", "decimal(18,3)")).cast("decimal(18,3)").alias("total_bags"), F.col("bank"), F.concat(F.lit("local-"), seller).alias("format_hint"),
    )


def bank_details(values: DataFrame) -> DataFrame:
    """(bill, bank) from printed values (bill, text, bank_name, account, branch): the first IFSC of the text, digits of the
    account, and of a branch that shares its field with a code, what is before the &; null if nothing is there."""
    ifsc = F.nullif(F.regexp_extract("text", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", 1), F.lit(""))
    branch = F.nullif(F.trim(F.element_at(F.split("branch", "&"), 1)), F.lit(""))
    account = F.nullif(F.regexp_replace("account", r"\D", ""), F.lit(""))
    name = F.nullif(F.trim("bank_name"), F.lit(""))
    bank = F.struct(name.alias("bank_name"), account.alias("account_number"), ifsc.alias("ifsc"), branch.alias("branch"))
    return values.select("bill", F.when(F.coalesce(name, account, ifsc, branch).isNotNull(), bank).alias("bank"))


def saved_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages (document_id, page_no, image_path, text_layer, ocr_text, text_quality) after another reading: what it has not
    read stays as it was."""
    fields = ("image_path", "text_layer", "ocr_text", "text_quality")
    prefer = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")) if c != "text_quality" else F.col(f"n.{c}"), F.col(f"o.{c}"))
    on = (F.col("o.document_id") == F.col("n.document_id")) & (F.col("o.page_no") == F.col("n.page_no"))
    return old.alias("o").join(new.alias("n"), on, "full").select(*(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in ("document_id", "page_no")), *(prefer(c).alias(c) for c in fields))


def located(words: DataFrame, needle: str, most: int = 8) -> DataFrame:
    """words (page, line, place, text) with the first run of at most so many words of a line that spells what column
    needle has, blanks and case aside: (page, line, first, last), the first page, line and place that do."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    by_line = words.groupBy("doc", "page", "line", needle).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda w: plain(w["text"])).alias("w"))
    spelled = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - a + 1)), lambda n: F.struct(a.alias("first"), (a + n - 1).alias("last"), F.array_join(F.slice("w", a, n), "").alias("t")))))
    hits = by_line.withColumn("hit", F.try_element_at(F.filter(spelled, lambda x: (x["t"] == plain(F.col(needle))) & (x["t"] != "")), F.lit(1))).where("hit is not null")
    return hits.groupBy("doc").agg(F.min(F.struct("page", "line", F.col("hit.first").alias("first"), F.col("hit.last").alias("last"))).alias("at")).select("doc", "at.*")


def best_quality(pages: DataFrame) -> DataFrame:
    """(document_id, quality): the best page's, 0 for a document whose pages have none."""
    return pages.groupBy("document_id").agg(F.coalesce(F.max("text_quality"), F.lit(0.0)).alias("quality"))
