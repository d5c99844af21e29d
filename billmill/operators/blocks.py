"""Who a bill is from and to: blocks of lines under a party's label, and the letterhead, on pages as lines of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.printed import IDENTIFIERS, found
from .layout import PAGE
from .tables import said

# Labels of parties and of columns beside them; lines that name nobody; titles of documents.
ROLES = {
    "consignee": r"(?i)^(details of consignee|shipped to|consignee\s*\(ship to\)|ship to|consignee)\b", "buyer": r"(?i)^(details of receiver|billed to|buyer\s*\(bill to\)|bill to|buyer\b(?!['’]s))",
    "seller": r"(?i)^(bill from|sold by|supplier|seller)\b",
}
COLUMN_LABEL = r"(?i)^(invoice\s*(no|dt|date)|dated|delivery note|dispatch|dispatched|mode/terms|terms of delivery|reference no|other references|buyer'?s order|e-?way bill|destination|ack\s*(no|date)|irn|details of consignee|details of receiver|consignee|buyer|billed to|shipped to|place of supply)\b"
NOT_A_NAME = r"(?i)^(irn|ack\s*no|ack\s*date|gstin|state\s*name|state\s*code|pan|fssai|e-?mail|tel|phone|invoice|dated|place of supply|comp\.|buyer'?s|delivery|dispatch|terms|reference|mode/terms|other references)"
TITLE = r"(?i)^(tax\s*invoice|e-?invoice|invoice|proforma|bill of supply|credit note|debit note|delivery challan|original|duplicate|triplicate|\(?e-?invoice qr code\)?)\b"
LONG_HEX = r"\b[0-9a-f]{16,64}\b"

#: Lines of a block and of a letterhead; points that a column to the right starts off, and that words may stick out.
BLOCK, LETTERHEAD, APART, LEFT, RIGHT = 9, 14, 30.0, 4.0, 2.0
#: Words that a label has at most.
LABEL_WORDS = 5


def role(text: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(text).rlike(p), F.lit(r)) for r, p in ROLES.items()))


def name_like(text: Column) -> Column:
    return (F.length(text) >= 3) & ~text.rlike(NOT_A_NAME) & ~text.rlike(IDENTIFIERS["gstin"]) & ~text.rlike(LONG_HEX) & text.rlike("[A-Za-z]{3,}")


def started(lines: DataFrame) -> DataFrame:
    """lines with starts, an array (x0, role, column): words where a party's label or a column's starts."""
    at = lambda x, i: F.struct(x["x0"].alias("x0"), role(said(F.slice("w", i + 1, LABEL_WORDS))).alias("role"), said(F.slice("w", i + 1, LABEL_WORDS)).rlike(COLUMN_LABEL).alias("column"))
    return lines.withColumn("starts", F.filter(F.transform("w", at), lambda s: s["role"].isNotNull() | s["column"]))


def described(texts: Column, whole: Column, named: Column) -> list[Column]:
    """name, gstin and further lines of a block's lines in order; named tells lines that may be a name."""
    spot = F.array_position(named, True)
    number = F.get(found(F.array_join(whole, "\n"), "gstin"), F.lit(0))
    return [F.when(spot > 0, F.get(texts, (spot - 1).cast("int"))).alias("name"), number.alias("gstin"), F.filter(texts, lambda t, i: i + 1 != spot).alias("lines")]


def parties(lines: DataFrame) -> DataFrame:
    """(doc, page, line, role, name, gstin, lines): a row for each label that has a name or a taxpayer number under it.

    A block is BLOCK lines long at most and ends at the next label of a party. It is as wide as its column: up to the
    next label to the right, unless that is of the same party. A label reads each line below it by an equal key.
    """
    page = started(lines).select(*PAGE, "line", "w", "starts")
    first = F.filter("starts", lambda s, i: s["role"].isNotNull() & (F.array_position(F.transform("starts", lambda t: t["role"]), s["role"]) == i + 1))
    labels = page.select(*PAGE, F.col("line").alias("label"), F.explode(first).alias("s")).select(*PAGE, "label", F.col("s.x0").alias("left"), "s.role")
    near = labels.withColumn("line", F.explode(F.sequence("label", F.col("label") + BLOCK))).join(page, [*PAGE, "line"])
    block = Window.partitionBy(*PAGE, "label", "role")
    aside = F.array_min(F.transform(F.filter("starts", lambda s: s["column"] & (s["x0"] > F.col("left") + APART) & ~s["role"].eqNullSafe(F.col("role"))), lambda s: s["x0"]))
    clipped = near.withColumn("right", F.min(aside).over(block)).where("line > label")
    mine = F.filter("w", lambda x: (x["x0"] >= F.col("left") - LEFT) & (F.col("right").isNull() | (x["x0"] < F.col("right") - RIGHT)))
    told = clipped.withColumn("text", F.trim(said(mine))).where("text <> ''").withColumn("next", F.min(F.when(role(F.col("text")).isNotNull(), F.col("line"))).over(block)).where("next is null or line < next")
    texts = told.groupBy(*PAGE, "label", "role").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t")).withColumn("t", F.transform("t", lambda t: t["text"]))
    t = F.col("t")
    return texts.select(*PAGE, F.col("label").alias("line"), "role", *described(t, t, F.transform(t, name_like))).where("name is not null or gstin is not null")


def letterheads(lines: DataFrame) -> DataFrame:
    """(doc, name, gstin, lines): what the first page says above its first party label, in its left column."""
    top = started(lines.where((F.col("page") == 1))).select("doc", "line", "w", "text", "starts")
    doc = Window.partitionBy("doc")
    labelled = F.exists("starts", lambda s: s["role"].isNotNull())
    head = top.withColumn("stop", F.min(F.when(labelled, F.col("line"))).over(doc)).where((F.col("line") < LETTERHEAD) & (F.col("stop").isNull() | (F.col("line") < F.col("stop"))))
    head = head.withColumn("left", F.min(F.get("w", F.lit(0))["x0"]).over(doc))
    aside = F.array_min(F.transform(F.filter("starts", lambda s: s["column"] & (s["x0"] > F.col("left") + APART)), lambda s: s["x0"]))
    clipped = head.withColumn("right", F.min(aside).over(doc))
    text = F.trim(said(F.filter("w", lambda x: F.col("right").isNull() | (x["x0"] < F.col("right") - RIGHT))))
    told = clipped.select("doc", "line", text.alias("own"), "text").where("own <> ''")
    gathered = told.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line", "own", "text"))).alias("t"))
    of = lambda f: F.transform("t", lambda t: t[f])
    return gathered.select("doc", *described(of("own"), of("text"), F.transform(of("own"), lambda t: name_like(t) & ~t.rlike(TITLE))))
