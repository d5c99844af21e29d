"""Two readings of a bill: where they differ, when a second is worth having, and how often a field is right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import alnum_upper, hsn
from .rules import ERROR

# Fields that get a second opinion and how they are compared; those of a goods line; when one is bought.
FIELDS = {"invoice_number": "text", "invoice_date": "date", "seller.name": "text", "seller.gstin": "gstin", "buyer.name": "text", "buyer.gstin": "gstin", "broker_name": "text", "taxable_value": "money", "grand_total": "money", "total_quantity": "money"}
LINE_FIELDS = {"taxable_amount": "money", "quantity": "money", "rate": "money", "description": "text"}
LARGE_BILL, SURE = 1_000_000, 0.9


def normal(kind: str, c: Column) -> Column:
    """A value as it is compared, in text: money to two places, identifiers and text without case and outer blanks."""
    money = c.cast("decimal(18,2)").cast("string")
    text = F.nullif(F.lower(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " "))), F.lit(""))
    return {"money": money, "gstin": alnum_upper(c.cast("string")), "hsn": hsn(c.cast("string")), "date": c.cast("date").cast("string"), "count": c.cast("long").cast("string")}.get(kind, text)


def column(path: str, name: str) -> Column:
    """A field of a column, by its path."""
    return reduce(lambda c, part: c.getField(part), path.split("."), F.col(name))


def readings_differ(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """(key, field_path, first, second) of every field of FIELDS in which two readings of a bill differ; lines (an array
    of structs) are compared one by one if both have as many, or else by their number alone."""
    row = lambda path, a, b, differ: F.when(differ, F.struct(path.alias("field_path"), a.alias("first"), b.alias("second")))
    pair = lambda kind, path, a, b: row(path, normal(kind, a), normal(kind, b), ~normal(kind, a).eqNullSafe(normal(kind, b)))
    both = first.select(key, F.struct(*(c for c in first.columns if c != key)).alias("a")).join(second.select(key, F.struct(*(c for c in second.columns if c != key)).alias("b")), key)
    heads = [pair(kind, F.lit(path), column(path, "a"), column(path, "b")) for path, kind in FIELDS.items()]
    lines = [F.coalesce(F.col(f"{x}.lines"), F.array().cast(first.schema["lines"].dataType)) for x in "ab"]
    n = [F.size(x) for x in lines]
    number = row(F.lit("lines"), n[0].cast("string"), n[1].cast("string"), n[0] != n[1])
    each = F.transform(F.arrays_zip(lines[0].alias("x"), lines[1].alias("y")), lambda z, i: F.array(*(pair(kind, F.concat(F.lit("lines."), (i + 1).cast("string"), F.lit(f".{f}")), z["x"][f], z["y"][f]) for f, kind in LINE_FIELDS.items())))
    found = F.concat(F.array(*heads, number), F.when(n[0] == n[1], F.flatten(each)).otherwise(F.array().cast("array<struct<field_path:string,first:string,second:string>>")))
    return both.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def disagreements(differing: DataFrame, key: str = "id") -> DataFrame:
    """A flag for each field in which readings differ."""
    return differing.select(F.col(key).alias("invoice_id"), F.lit("readings_disagree").alias("rule"), F.lit(ERROR).alias("severity"), "field_path", F.col("first").alias("expected"), F.col("second").alias("actual"))


def second_reading(route: Column, total: Column, confidence: Column, model: str | None, first_model: str, key: bool = True, enabled: bool = True) -> Column:
    """The model that should read a bill again, or null: where the text isn't a layer of its own, the bill is large, or
    the first reading unsure; nobody, if it is off, has no key, or would be the same model."""
    if not (enabled and key and model and model != first_model):
        return F.lit(None).cast("string")
    wanted = ~route.eqNullSafe(F.lit("text_layer")) | F.coalesce(total >= LARGE_BILL, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < SURE)
    return F.when(wanted, F.lit(model))


def agreement(truth: DataFrame, read: DataFrame, kinds: dict[str, str], checked: set[str], key: str = "id") -> DataFrame:
    """(field, checked, hits, total): how often a reading equals the truth once both are normal; checked fields are those
    that arithmetic can verify."""
    t, r = truth.alias("t"), read.alias("r")
    both = t.join(r, F.col(f"t.{key}") == F.col(f"r.{key}"), "left")
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(f in checked).alias("checked"), normal(k, F.col(f"t.{f}")).eqNullSafe(normal(k, F.col(f"r.{f}"))).alias("ok")) for f, k in kinds.items()))
    return both.select(F.explode(rows).alias("x")).groupBy("x.field", "x.checked").agg(F.count_if("x.ok").alias("hits"), F.count("*").alias("total"))
