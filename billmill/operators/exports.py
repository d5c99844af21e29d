"""Whole exports of bills and lines, their filters and files, and the lists of documents, recordings and deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bridge import counted
from .lifecycle import SUFFIXES
from .reports import within

# The columns of either export, in order; in a bill's, what isn't named as in the ledger is given its source.
INVOICE = ["invoice_id", "invoice_number", "invoice_date", "financial_year", "document_type", "seller", "seller_gstin", "buyer", "buyer_gstin", "consignee", "broker", "transporter", "vehicle_no", "eway_bill_no", "place_of_supply", "supply_type", "payment_terms", "due_date", "total_quantity", "uom", "total_bags", "subtotal", "discount_total", "taxable_value", "cgst", "sgst", "igst", "cess", "tcs", "other_charges", "round_off", "grand_total", "amount_paid", "payment_status", "status", "confidence", "irn", "source_file"]
LINE = ["invoice_id", "invoice_number", "invoice_date", "seller", "buyer", "line_no", "description", "item_code", "grade", "brand", "product", "hsn", "bags", "quantity", "uom", "rate", "discount_pct", "taxable_amount", "tax_rate", "cgst", "sgst", "igst"]
SOURCES = {"invoice_id": "id", "uom": "total_quantity_uom", "cgst": "cgst_amount", "sgst": "sgst_amount", "igst": "igst_amount", "cess": "cess_amount", "tcs": "tcs_amount"}
LINE_SOURCES = {"grade": "item_remarks", "cgst": "cgst_amount", "sgst": "sgst_amount", "igst": "igst_amount"}
CLIP_STATUSES = ("pending", "confirmed", "corrected")


def chosen(bills: DataFrame, seller_id: int | None = None, buyer_id: int | None = None, status: str | None = None, **dates: str | None) -> DataFrame:
    """The bills that an export has: those that count or, with a status, those of that status instead."""
    rows = within(bills.where(F.col("status") == status) if status else counted(bills), **dates)
    rows = rows.where(F.col("seller_id") == seller_id) if seller_id else rows
    return rows.where(F.col("buyer_id") == buyer_id) if buyer_id else rows


def shown(parties: DataFrame) -> Column:
    """A party's name as it is shown."""
    return F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.col("legal_name")) if "display_name" in parties.columns else F.col("legal_name")


def payment_status(paid: Column, total: Column) -> Column:
    """paid, partial or unpaid."""
    return F.when(F.coalesce(paid, F.lit(0)) <= 0, "unpaid").when(paid >= total, "paid").otherwise("partial")


def source(df: DataFrame, name: str) -> Column:
    """A column as an export shows it: decimals as doubles, null if the ledger has none."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.col(name).cast("double") if df.schema[name].dataType.typeName() == "decimal" else F.col(name)


def named(bills: DataFrame, parties: DataFrame, roles: tuple[str, ...], numbers: tuple[str, ...] = ()) -> DataFrame:
    """bills with each role's name and, for some, taxpayer number: one join a role, by key."""
    out = bills
    for r in roles:
        if f"{r}_id" not in out.columns:
            out = out.withColumn(r, F.lit(None).cast("string"))
            continue
        one = parties.select(F.col("party_id").alias("_id"), F.col("legal_name").alias(r), *([F.col("gstin").alias(f"{r}_gstin")] if r in numbers and "gstin" in parties.columns else []))
        out = out.join(one, F.col(f"{r}_id") == F.col("_id"), "left").drop("_id")
    return out


def invoices(bills: DataFrame, parties: DataFrame, **filters: object) -> DataFrame:
    """The 38 columns of the export of bills, by date (missing ones last) and id."""
    rows = named(chosen(bills, **filters), parties, ("seller", "buyer", "consignee", "broker", "transporter"), ("seller", "buyer"))
    rows = rows.withColumn("broker", F.when(F.col("broker_id").isNull(), F.col("broker_name_raw")).otherwise(F.col("broker")))
    if "payment_status" not in rows.columns:
        rows = rows.withColumn("payment_status", payment_status(F.col("amount_paid"), F.col("grand_total")))
    return rows.select(*(source(rows, SOURCES.get(c, c)).alias(c) for c in INVOICE)).orderBy(F.asc_nulls_last("invoice_date"), "invoice_id")


def lines(lines_: DataFrame, bills: DataFrame, parties: DataFrame, products: DataFrame, **filters: object) -> DataFrame:
    """The 22 columns of the export of lines, by the bill's date and id and the line's number."""
    heads = named(chosen(bills, **filters), parties, ("seller", "buyer")).select(F.col("id").alias("invoice_id"), "invoice_number", "invoice_date", "seller", "buyer")
    rows = lines_.join(products.select("product_id", F.col("name").alias("product")), "product_id", "left").join(heads, "invoice_id")
    return rows.select(*(source(rows, LINE_SOURCES.get(c, c)).alias(c) for c in LINE)).orderBy(F.asc_nulls_last("invoice_date"), "invoice_id", "line_no")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def write_jsonl(rows: DataFrame, path: str, part: str = "part") -> None:
    """A JSON object a line; rows of each part in a folder of its own."""
    rows.write.partitionBy(part).mode("overwrite").json(path)


def bill_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """The bills of a folder (path, filename, content, modificationTime) by path: files of known kinds, but for hidden ones."""
    ends = "|".join(s.removeprefix(".") for s in SUFFIXES)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).withColumn("filename", name)
    files = files if recursive else files.where(~F.substring_index("path", folder.rstrip("/") + "/", -1).contains("/"))
    return files.where(F.col("filename").rlike(rf"(?i)^[^.].*\.({ends})$")).select("path", "filename", "content", "modificationTime").orderBy("path")


def document_list(documents: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = documents.where(F.col("status") == status) if status else documents
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def newest(rows: DataFrame, limit: int = 50, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(key)).limit(limit)


def clip_counts(clips: DataFrame) -> DataFrame:
    """How many recordings have each status, none counting as 0: one row."""
    return clips.agg(*(F.count_if(F.col("status") == s).alias(s) for s in CLIP_STATUSES))


def paged(rows: DataFrame, order: list[Column], limit: int, offset: int) -> tuple[DataFrame, int]:
    """A page, and how many rows there are in all."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def one(rows: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The row of a key; none, if it isn't there."""
    return rows.where(F.col(key) == value).limit(1)
