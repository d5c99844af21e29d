"""What is printed on a bill: figures with units, identifiers that prove themselves, kinds of bills, and how a stored
value would look in print. And whose reading counts where a sentence was read twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import blank_to_null, checksum_ok, indian

# Formats of identifiers, headings of bills other than tax invoices, forms that dates are printed in.
IDENTIFIERS = {
    "gstin": r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d])\b", "pan": r"\b([A-Z]{5}\d{4}[A-Z])\b", "irn": r"\b([0-9a-f]{64})\b", "fssai": r"\b(\d{14})\b", "eway": r"\b(\d{12})\b", "ack": r"\b(\d{15})\b",
    "ifsc": r"\b([A-Z]{4}0[A-Z\d]{6})\b", "email": r"\b([\w.+-]+@[\w-]+\.[\w.-]+)\b", "pin": r"\b([1-9]\d{5})\b",
}
HEADINGS = ("credit note", "debit note", "proforma", "bill of supply", "delivery challan")
DATES = ("dd-MMM-yy", "dd-MMM-yyyy", "dd/MM/yyyy", "dd/MM/yy", "dd-MM-yyyy", "dd.MM.yyyy", "dd MMM yyyy", "yyyy-MM-dd")
#: A batch of requests costs this share of single ones.
BATCH = 0.5


def figure(c: Column) -> Column:
    """A figure as printed, as decimal(38,6): signs other than digits and one point don't count, but for a minus."""
    text = F.trim(c)
    digits = F.regexp_replace(text, r"[^\d.]", "")
    value = F.when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), digits).try_cast("decimal(38,6)")
    return F.when(text.contains("(-)") | text.startswith("-") | text.rlike(r"^\(.*\)$"), -value).otherwise(value)


def quantity(c: Column) -> Column:
    """(number, unit) of a figure with its unit: the first part that is a figure, the first other one with a letter."""

    def read(x: Column) -> Column:
        at = F.array_position(F.transform(x["figures"], lambda f: f.isNotNull()), True) - 1
        units = F.filter(x["parts"], lambda p, i: (i != at) & p.rlike(r"\p{L}"))
        return F.struct(F.when(at >= 0, F.get(x["figures"], at.cast("int"))).cast("double").alias("number"), F.upper(F.get(units, F.lit(0))).alias("unit"))

    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  # so that parts and figures are made once
    parts = F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " ")
    return once(parts, lambda p: once(F.struct(p.alias("parts"), F.transform(p, figure).alias("figures")), read))


def document_type(text: Column) -> Column:
    """By the first heading that the first six lines have."""
    head = F.lower(F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 6), " "))
    kinds = [(h, "proforma_invoice" if h == "proforma" else h.replace(" ", "_")) for h in HEADINGS]
    return F.coalesce(*(F.when(head.contains(h), k) for h, k in kinds), F.lit("tax_invoice"))


def broker(c: Column) -> Column:
    """A broker's name without a rate that is printed after it; a code stays."""
    text = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    before = F.trim(F.substring_index(text, "%", 1))
    rated = figure(F.element_at(F.split(before, " "), -1)).isNotNull()
    cleaned = F.when(~text.contains("%"), text).when(rated, F.regexp_replace(before, r"\s*\S+$", "")).otherwise(before)
    return blank_to_null(F.regexp_replace(cleaned, r"^[ .:-]+|[ .:-]+$", ""))


def found(text: Column, kind: str) -> Column:
    """Identifiers of one kind in a text, in order; taxpayer numbers only with a right checksum."""
    all_ = F.regexp_extract_all(text, F.lit(IDENTIFIERS[kind]), F.lit(1))
    return F.filter(all_, checksum_ok) if kind == "gstin" else all_


def reference_number(text: Column) -> Column:
    """The 64 hex digits of a registered bill, in one run or in two that follow each other."""
    runs = F.regexp_extract_all(text, F.lit(r"\b([0-9a-f]{16,64})\b"), F.lit(1))
    pairs = F.transform(runs, lambda r, i: F.concat(r, F.get(runs, i + 1)))
    return F.get(F.filter(F.concat(runs, pairs), lambda r: F.length(r) == 64), F.lit(0))


def remaining(numbers: Column, others: Column) -> Column:
    """The first of numbers that is none of others: the seller's, once the other parties' are known."""
    return F.get(F.array_except(numbers, others), F.lit(0))


def date_forms(d: Column) -> Column:
    return F.when(d.isNull(), F.array().cast("array<string>")).otherwise(F.array(*(F.date_format(d, f) for f in DATES)))


def number_forms(n: Column) -> Column:
    """How a decimal may be printed: grouped in the Indian and the western way, plain, with three places; whole ones bare."""
    two = F.bround(n, 2).cast("decimal(20,2)")
    west = lambda s: F.regexp_replace(s, r"(?<=\d)(?=(\d{3})+(?!\d))", ",")
    grouped = F.concat(west(F.substring_index(two.cast("string"), ".", 1)), F.lit("."), F.substring_index(two.cast("string"), ".", -1))
    bare = n.cast("decimal(20,0)").cast("string")
    forms = F.array(indian(two), grouped, two.cast("string"), F.bround(n, 3).cast("decimal(21,3)").cast("string"))
    whole = F.array(F.regexp_replace(indian(two), r"\.00$", ""), west(bare), bare)
    return F.when(n.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.when(n == n.cast("decimal(20,0)"), F.concat(forms, whole)).otherwise(forms)))


def cost(prices: dict[str, tuple[float, float]], model: Column, tokens_in: Column, tokens_out: Column, batch: Column) -> Column:
    """Dollars for a request, by dollars a million tokens in and out; null for a model without a price."""
    priced = lambda kv: (tokens_in * kv[1][0] + tokens_out * kv[1][1]) / 1e6
    each = reduce(lambda acc, kv: acc.when(model == kv[0], priced(kv)), prices.items(), F.when(F.lit(False), F.lit(0.0)))
    return each * F.when(batch, BATCH).otherwise(1.0)


def settled(field: str, rules: Column, model: Column, known: Column) -> Column:
    """(value, read_by, model_said) of a field that rules and a model have read. Figures are the rules' alone, and what
    the model said of one that differs is kept beside it; goods are the model's unless the rules knew them; a party is
    the model's where the rules have none."""
    none = F.lit(None).cast("string")
    if field in ("quantity", "rate", "uom"):
        by = F.when(rules.isNotNull(), "rules").when(model.isNotNull(), "unread")
        return F.struct(rules.cast("string").alias("value"), by.alias("read_by"), F.when(~rules.eqNullSafe(model), model.cast("string")).alias("model_said"))
    theirs = F.coalesce(model != "", F.lit(False)) & (~F.coalesce(known, F.lit(False)) if field == "goods" else rules.isNull())
    return F.struct(F.when(theirs, model).otherwise(rules).alias("value"), F.when(theirs, "model").when(rules.isNotNull(), "rules").alias("read_by"), none.alias("model_said"))
