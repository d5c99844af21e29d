"""Dictated deals: numbers in words, what a deal is worth, its read-back, and labels of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import NUMBER_WORDS, SCALES, indian, lookup, words_value

DIGITS = [w for w, v in NUMBER_WORDS.items() if v < 10]
TEENS = [w for w, v in NUMBER_WORDS.items() if 10 <= v < 20]


def number(text: Column) -> Column:
    """A number said in words. With a scale word it is added up; without one, what is said is read off in groups (tens
    and a unit make one), so that 'eight thirteen' is 813. Null if no number word occurs."""
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda t: lookup(NUMBER_WORDS)[t].isNotNull())
    values = F.transform(tokens, lambda t: lookup(NUMBER_WORDS)[t])
    joins = lambda a, v: (a["last"] >= 20) & (a["last"] % 10 == 0) & v.between(1, 9)
    start = F.struct(F.lit("").alias("said"), F.lit(-1).alias("last"))
    step = lambda a, v: F.struct(F.concat(a["said"], F.when(a["last"] >= 0, F.when(joins(a, v), "").otherwise(a["last"].cast("string"))).otherwise("")).alias("said"), F.when(joins(a, v), a["last"] + v).otherwise(v).alias("last"))
    done = F.aggregate(values, start, step)
    read_off = F.when(done["last"] >= 0, F.concat(done["said"], done["last"].cast("string")).try_cast("bigint"))
    scaled = F.lower(text).rlike(r"\b(hundred|" + "|".join(SCALES) + r")\b")
    return F.when(scaled, words_value(text)).otherwise(read_off)


def value(quantity: Column, rate: Column) -> Column:
    """What a deal is worth, to two places, half-even; null unless both are said."""
    return F.bround((quantity.cast("decimal(18,3)") * rate.cast("decimal(18,2)")).cast("decimal(36,5)"), 2)


def plain(n: Column) -> Column:
    """Indian grouping without a fraction that is zero."""
    return F.regexp_replace(indian(n.cast("decimal(20,2)")), r"\.00$", "")


# What one and several of a unit are called.
SINGULAR = {"BAGS": "bag", "KGS": "kg", "QTL": "quintal", "MT": "tonne", "BOX": "box", "PCS": "piece"}
PLURAL = {"BAGS": "bags", "KGS": "kg", "QTL": "quintal", "MT": "tonnes", "BOX": "boxes", "PCS": "pieces"}


def read_back(seller: Column, buyer: Column, goods: Column, quantity: Column, unit: Column, rate: Column) -> Column:
    """The deal as a sentence with what it comes to; what wasn't heard is left out, null if nothing was."""
    many = F.coalesce(lookup(PLURAL)[unit], F.lower(F.coalesce(unit, F.lit(""))))
    sides = F.when(seller.isNotNull() & buyer.isNotNull(), F.concat(seller, F.lit(" sold "), buyer)).when(seller.isNotNull(), F.concat(seller, F.lit(" sold"))).when(buyer.isNotNull(), F.concat(F.lit("Sold to "), buyer)).otherwise("Sold")
    amount = F.trim(F.concat(plain(quantity), F.lit(" "), many))
    what = F.when(quantity.isNotNull(), F.concat(F.lit("of "), goods)).otherwise(goods)
    price = F.concat(F.lit("at "), plain(rate), F.coalesce(F.concat(F.lit(" per "), lookup(SINGULAR)[unit]), F.lit("")))
    total = F.concat(F.lit(" — "), plain(value(quantity, rate)))
    heard = F.coalesce(seller, buyer, goods, quantity.cast("string"), rate.cast("string")).isNotNull()
    return F.when(heard, F.concat(F.concat_ws(" ", sides, amount, what, price), F.coalesce(total, F.lit("")), F.lit(".")))


def tidied(said: Column) -> Column:
    """A name as a deal keeps it: single spaces, no points or commas about it, null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(said, r"(?U)\s+", " "), "^[ .,]+|[ .,]+$", ""), F.lit(""))


def figure(said: Column) -> Column:
    """A quantity or a rate as a deal keeps it, whatever signs are about its digits; null if there is none."""
    return F.regexp_replace(said, r"[^\d.\-]", "").try_cast("double")


def saved(deals: DataFrame, today: str) -> DataFrame:
    """Deals as they are stored: names tidied, figures read, the value of both, and a date."""
    out = deals.withColumns({f: tidied(F.col(f)) for f in ("seller", "buyer", "goods")} | {f: figure(F.col(f)) for f in ("quantity", "rate")})
    return out.withColumns({"value": value(F.col("quantity"), F.col("rate")), "traded_on": F.coalesce(F.col("traded_on").cast("date"), F.lit(today).cast("date"))})


def fitting(terms: DataFrame, budget: int, order: str = "n", term: str = "term") -> DataFrame:
    """The terms, in order, that fit a prompt of so many characters; the first that doesn't ends it. A term takes two
    characters at least, so more than budget / 2 rows are never looked at."""
    top = terms.orderBy(order, term).limit(budget // 2 + 1)
    so_far = F.sum(F.length(term) + 1).over(Window.orderBy(order, term))
    return top.withColumn("used", so_far.cast("long")).where(F.col("used") <= budget)


def label(heard: Column, said: Column) -> Column:
    """Whether what a person says was said is what was heard."""
    return F.when(said == F.regexp_replace(heard, r"(?U)^\s+|\s+$", ""), "confirmed").otherwise("corrected")
