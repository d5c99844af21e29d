"""What a bill's text and rows say: payloads of codes, identifiers in text, rows told apart, figures reconciled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a charge's kind, the first kind found wins; words of tax rows and of restated totals.
CHARGES = [("round_off", "round off|r/off|rounded off|roundoff"), ("tcs", "tcs"), ("tds", "tds"), ("packing", "packing|packaging"), ("labour", "labour|labor|hamali"), ("freight", "freight|transport|carriage|lorry"), ("handling", "handling"), ("insurance", "insurance"), ("discount", "discount|rebate|cash disc")]
TAX = r"(?i)\b(output\s+)?(c ?gst|s ?gst|i ?gst|ugst|cess|tcs|tds)\b"
TOTAL = r"(?i)\b(taxable\s+(value|amount)|sub\s*total|gross\s+(value|amount|total)|total\s+(value|amount|before\s+tax)|net\s+(value|amount)|grand\s+total|invoice\s+(value|total))\b"


def jws_claim(token: Column, path: str) -> Column:
    """A value of a signed code's data, which is JSON, or JSON in a string."""
    body = F.unbase64(F.translate(F.split(token, r"\.")[1], "-_", "+/")).cast("string")
    return F.get_json_object(F.get_json_object(body, "$.data"), path)


def eway_part(text: Column, name: str) -> Column:
    return F.trim(F.str_to_map(text, F.lit("/"), F.lit(":"))[name])


def row_class(text: Column, quantity: Column, amount: Column) -> Column:
    """goods, tax, total, or charge:kind, of a table row."""
    low, bare = F.lower(text), F.trim(F.coalesce(quantity, F.lit(""))) == ""
    out = F.when(bare & low.rlike(TAX), "tax").when(bare & low.rlike(TOTAL), "total")
    out = reduce(lambda acc, kv: acc.when(bare & low.rlike(kv[1]), f"charge:{kv[0]}"), CHARGES, out)
    nameless = F.when(F.trim(text) != "", "charge:other").otherwise("total")
    return out.when(bare & (F.coalesce(amount, F.lit("")) != ""), nameless).otherwise("goods")


def unglued(serial: Column, description: Column) -> Column:
    """(serial, description) with letters that ran into the serial number given back to the description."""
    glued, number = r"(?s)^(\d{1,3})([A-Za-z].*)$", r"^\(?-?[\d,]+(?:\.\d+)?\)?$"
    s = F.trim(serial)
    spill = F.when(s.rlike(glued), F.trim(F.regexp_extract(s, glued, 2))).when((s == "") | s.rlike(number), "").otherwise(s)
    left = F.when(s.rlike(glued), F.regexp_extract(s, glued, 1)).when(s.rlike(number), s).otherwise("")
    return F.struct(left.alias("serial"), F.when(spill != "", F.trim(F.concat_ws(" ", spill, description))).otherwise(description).alias("description"))


def reconciled(values: Column, tolerance: float = 1.0) -> Column:
    """Of the sources' values, in order, the one that most of them agree with; the first of equals."""

    def best(some: Column) -> Column:
        return F.array_max(F.transform(some, lambda v, i: F.struct(F.size(F.filter(some, lambda w: F.abs(w - v) <= tolerance)).alias("n"), (-i).alias("at"), v.alias("v"))))["v"]

    return F.get(F.transform(F.array(F.filter(values, lambda v: v.isNotNull())), best), F.lit(0))  # so that the values are made once


def reading_confidence(agree: Column, lines: Column, balanced: Column, gstins: Column, code: Column) -> Column:
    part = lambda c, v: F.when(c, F.lit(v).cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))
    return F.least(F.lit("0.50").cast("decimal(4,2)") + part(agree >= 2, "0.20") + part(lines > 0, "0.05") + part(balanced, "0.10") + part(gstins, "0.10") + part(code, "0.05"), F.lit("0.98").cast("decimal(4,2)")).cast("double")


def consistent(text: Column, *needles: Column) -> Column:
    """Two or more of the code's values are in the text, signs other than letters and digits aside."""
    squash = lambda c: F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    return sum((F.when(F.coalesce(squash(text).contains(F.nullif(squash(n), F.lit(""))), F.lit(False)), 1).otherwise(0) for n in needles), F.lit(0)) >= 2
