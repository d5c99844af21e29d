"""A bill's life: arrival, nested and flat forms, blanks filled from lines, edits with their log, confirmation, scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bridge import financial_year

# What may be uploaded, and how much of it.
SUFFIXES = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}
LARGEST_MB = 32


def arrivals(files: DataFrame, largest: int = LARGEST_MB << 20) -> DataFrame:
    """files (id, filename, content binary) with sha256, outcome and, of what is stored, its path.

    The first file of a content (least id) is stored and others are duplicates; what is refused isn't a copy of
    anything. First files come from an aggregate that is combined before the shuffle, so one content may have many.
    """
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^./]+)$", 1))
    refused = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty").when(F.length("content") > largest, "too_large").when(~suffix.isin(*SUFFIXES), "bad_suffix")
    hashed = files.withColumns({"suffix": suffix, "refused": refused, "sha256": F.sha2("content", 256)}).drop("content")
    first = hashed.where("refused is null").groupBy("sha256").agg(F.min("id").alias("first_id"))
    outcome = F.coalesce("refused", F.when(F.col("id") != F.col("first_id"), "duplicate"), F.lit("stored"))
    path = F.concat_ws("/", F.lit("files"), F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), F.concat("sha256", "suffix"))
    return hashed.join(first, "sha256", "left").withColumn("outcome", outcome).select("id", "sha256", "outcome", F.when(F.col("outcome") == "stored", path).alias("path"))


def spread(texts: DataFrame) -> DataFrame:
    """texts over as many tasks as there are cores, where their files give fewer."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores)


def page_texts(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """(key, text): a document's pages in order, each under a line with its number; blank pages are left out."""
    some = pages.where(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "")
    headed = F.struct(F.col(number).alias("n"), F.concat(F.lit("--- page "), F.col(number).cast("string"), F.lit(" ---\n"), F.col(text)).alias("t"))
    return some.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(headed)), lambda p: p["t"]), "\n\n").alias("text"))


def nested(lines: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, json): the rows of a bill as one array in JSON."""
    return lines.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(order, *fields)))).alias("json"))


def unnested(bills: DataFrame, key: str, schema: str) -> DataFrame:
    """The rows of what nested made, by a schema of one of them."""
    return bills.select(key, F.explode(F.from_json("json", f"array<struct<{schema}>>")).alias("r")).select(key, "r.*")


def filled(bills: DataFrame, lines: DataFrame) -> DataFrame:
    """bills (id, taxable_value, total_quantity, uom), blanks filled from lines (invoice_id, taxable_amount, quantity, uom):
    sums, and the unit where all lines that have one have the same. What is printed stays."""
    sums = lines.groupBy("invoice_id").agg(F.sum("taxable_amount").alias("_t"), F.sum("quantity").alias("_q"), F.min("uom").alias("_u"), F.max("uom").alias("_v"))
    out = bills.join(sums, F.col("id") == F.col("invoice_id"), "left")
    unit = F.when(F.col("_u") == F.col("_v"), F.col("_u"))
    return out.select("id", F.coalesce("taxable_value", F.col("_t").cast("decimal(18,2)")).alias("taxable_value"), F.coalesce("total_quantity", F.col("_q").cast("decimal(18,3)")).alias("total_quantity"), F.coalesce("uom", unit).alias("uom"))


def charge_totals(charges: DataFrame) -> DataFrame:
    """A bill's charges (invoice_id, kind, amount) by what they do to its total: discounts always lower it."""
    part = lambda when, amount: F.coalesce(F.sum(F.when(when, amount)), F.lit(0)).cast("decimal(18,2)")
    kind, amount = F.col("kind"), F.col("amount")
    return charges.groupBy("invoice_id").agg(
        part(kind == "discount", -F.abs(amount)).alias("discounts"), part(kind == "round_off", amount).alias("round_off"),
        part(kind.isin("tcs", "tds"), amount).alias("collected"), part(~kind.isin("discount", "round_off", "tcs", "tds"), amount).alias("additions"),
    )


def edited(bills: DataFrame, edits: DataFrame, fields: list[str], cleaners: dict[str, Callable[[Column], Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(bills after edits, log of corrections). edits: id, field, value, in strings, one of a field; an edit that
    changes nothing isn't logged, nor is one of a field that can't be edited. Values are cleaned by their field's cleaner
    (text that is only trimmed, if it has none); a bill whose date changes gets the year of the new one."""
    asked = edits.where(F.col("field").isin(*fields)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("asked"))
    both = bills.join(asked, "id", "left")
    named = lambda f: F.coalesce(F.array_contains(F.map_keys("asked"), f), F.lit(False))
    kinds = {f: bills.schema[f].dataType for f in fields}
    clean = lambda f: (cleaners or {}).get(f, lambda c: F.nullif(F.trim(c), F.lit("")))
    both = both.withColumns({f"_new_{f}": clean(f)(F.try_element_at("asked", F.lit(f))).cast(kinds[f]) for f in fields})
    new = lambda f: F.col(f"_new_{f}")
    after = both.withColumns({f: F.when(named(f), new(f)).otherwise(F.col(f)) for f in fields}).drop("asked")
    if "invoice_date" in fields and "financial_year" in bills.columns:
        moved = named("invoice_date") & ~F.col("invoice_date").eqNullSafe(new("invoice_date"))
        years = both.where(moved).select("id", financial_year(new("invoice_date")).alias("_fy"), F.lit(True).alias("_moved"))
        after = after.join(years, "id", "left").withColumn("financial_year", F.when(F.col("_moved"), F.col("_fy")).otherwise(F.col("financial_year"))).drop("_fy", "_moved")
    rows = F.array(*(F.when(named(f) & ~F.col(f).cast("string").eqNullSafe(new(f).cast("string")), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), new(f).cast("string").alias("after"))) for f in fields))
    log = both.where("asked is not null").select("id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("id", "r.*")
    return after.select(*bills.columns), log


def document_status(before: Column, event: Column) -> Column:
    """A document's status after an event: what is being read, read, to be looked at, not readable, or to be tried again."""
    moves = {"start": "processing", "read": "extracted", "flagged": "needs_review", "confirm": "confirmed", "error": "failed", "retry": "queued"}
    to = reduce(lambda c, kv: c.when(event == kv[0], kv[1]), moves.items(), F.when(F.lit(False), ""))
    return F.when(before == "confirmed", before).otherwise(F.coalesce(to, before))


def confirmable(bills: DataFrame, flags: DataFrame, forced: Column | None = None) -> DataFrame:
    """(id, ok): bills without an unresolved error, or forced."""
    errors = flags.where("severity = 'error' and not resolved").select(F.col("invoice_id").alias("id")).distinct().withColumn("_e", F.lit(True))
    return bills.join(errors, "id", "left").select("id", (F.col("_e").isNull() | (F.lit(False) if forced is None else forced)).alias("ok"))


def same(kind: str, a: Column, b: Column) -> Column:
    """Whether a value read is the true one: money within 1, names by letters and digits, others as they are."""
    squash = lambda c: F.lower(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    if kind == "money":
        close = F.abs(a.cast("decimal(18,2)") - b.cast("decimal(18,2)")) <= 1
        return F.coalesce(close, a.isNull() & b.isNull())
    return squash(a).eqNullSafe(squash(b)) if kind == "text" else a.eqNullSafe(b)


def scores(truth: DataFrame, read: DataFrame, kinds: dict[str, str], key: str = "id") -> DataFrame:
    """(field, hits, total, percent) over all true rows; a row that wasn't read misses where the truth has a value."""
    t, r = truth.alias("t"), read.alias("r")
    both = t.join(r, F.col(f"t.{key}") == F.col(f"r.{key}"), "left")
    rows = F.array(*(F.struct(F.lit(f).alias("field"), same(k, F.col(f"t.{f}"), F.col(f"r.{f}")).alias("ok")) for f, k in kinds.items()))
    tally = both.select(F.explode(rows).alias("s")).groupBy("s.field").agg(F.count_if(F.col("s.ok")).alias("hits"), F.count("*").alias("total"))
    return tally.withColumn("percent", F.round(100 * F.col("hits") / F.col("total"), 1))


def supply_type(seller_state: Column, buyer_state: Column) -> Column:
    return F.when(seller_state == buyer_state, "intra").when(seller_state != buyer_state, "inter")


def pan(gstin: Column) -> Column:
    """The taxpayer's account number within a cleaned identifier of 15 signs."""
    inner = F.substring(gstin, 3, 10)
    return F.when((F.length(gstin) == 15) & inner.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), inner)
