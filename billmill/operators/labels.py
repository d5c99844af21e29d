"""Values by the label that is printed beside or above them, on pages as lines of words (tables.by_line)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import blank_to_null, lookup
from .layout import PAGE
from .tables import COLUMN_GAP, down, said, tidy

# Labels that bills print; what stands there is never a value.
KNOWN = (
    "invoice no", "invoice number", "invoice dt", "invoice date", "bill no", "dated", "date", "delivery note", "delivery note date", "mode/terms of payment", "terms of payment", "payment terms", "reference no. & date.",
    "reference no", "other references", "buyer's order no", "buyers order no", "dispatch doc no", "dispatched through", "destination", "terms of delivery", "e-way bill no", "eway bill no", "e way bill no", "broker name", "broker",
    "representative", "agent", "ack no", "ack date", "ack dt", "irn", "po no. & dt", "place of supply", "state name", "state code", "gstin", "gstin/uin", "consignee", "buyer", "billed to", "shipped to", "remarks",
    "transporter id", "transporter name", "transporter gstin", "transin", "doc no", "vehicle no", "cewb no", "generated date", "generated by", "valid upto", "approx distance", "supply type", "transaction type", "mode", "name",
    "from", "to", "dispatch from", "ship to", "address details", "goods details", "transportation details", "vehicle details", "e-way bill details", "tot.taxable amt", "other amt", "total inv amt",
)
# Labels of what has no column of its own, and of what a reading should have if the page names it.
EXTRAS = {
    "Previous Balance": ("previous balance",), "Current Balance": ("current balance",), "Ship From": ("ship from",), "Dispatched through": ("dispatched through",), "Destination": ("destination",), "Terms of Delivery": ("terms of delivery",),
    "Delivery Note": ("delivery note",), "Buyer's Order No.": ("buyer's order no", "buyers order no"), "Reference No. & Date.": ("reference no. & date.",), "Other References": ("other references",), "Representative": ("representative",),
    "Buyer's PAN": ("buyer's pan no", "buyer's pan"), "Tax Amount (in words)": ("tax amount (in words)", "tax amt in words"),
}
EXPECTED = {
    "a transporter": ("transporter id", "transporter name", "transporter"), "a vehicle number": ("vehicle no", "vehicle number"), "a broker": ("broker name", "broker", "representative"),
    "bank details": ("bank name", "a/c no", "account no", "ifsc code"), "a place of supply": ("place of supply",), "payment terms": ("mode/terms of payment", "terms of payment"),
}

#: Words in a label; points that a value may start left of its label, and has to stay left of the next one.
MOST, LEFT, RIGHT = 4, 8.0, 2.0


def plain(label: str) -> str:
    return " ".join(re.sub("[^a-z0-9/&. ]+", " ", label.lower()).split()).rstrip(" :.")


def key(c: Column) -> Column:
    """plain() of a column."""
    return F.regexp_replace(tidy(F.regexp_replace(F.lower(c), "[^a-z0-9/&. ]+", " ")), "[ :.]+$", "")


def bare(c: Column) -> Column:
    return F.regexp_replace(c, "^[ :]+|[ :]+$", "")


#: All labels, and what they may be cut down to by the end of a run.
WHOLE = {plain(k): True for k in KNOWN}
OPENINGS = {" ".join(k.split()[:n]): True for k in WHOLE for n in range(1, len(k.split()) + 1)}


def is_label(c: Column) -> Column:
    """Blank, a label or the start of one, or a numbered heading without a further digit."""
    heading = c.rlike(r"^\d+\s*[.)]\s*\S") & ~F.regexp_replace(c, r"(?s)^.{2}", "").rlike(r"(?U)\d")
    return heading | key(c).isin("", *OPENINGS)


def beside(w: Column, start: Column) -> Column:
    """Words from start on, up to a wide gap or up to where they make up a label."""

    def more(a: Column, x: Column) -> Column:
        text = bare(x["text"])
        longer = F.when(a["text"] == "", text).otherwise(F.concat_ws(" ", a["text"], text))
        over = a["over"] | ((a["text"] != "") & (x["x0"] - a["x1"] > COLUMN_GAP)) | ((text != "") & key(longer).isin(*WHOLE))
        return F.struct(F.when(over | (text == ""), a["text"]).otherwise(longer).alias("text"), over.alias("over"), x["x1"].alias("x1"))

    begin = F.struct(F.lit("").alias("text"), F.lit(False).alias("over"), F.lit(0.0).alias("x1"))
    return bare(F.aggregate(F.slice(w, start + 1, F.greatest(F.size(w) - start, F.lit(0))), begin, more, lambda a: a["text"]))


def under(w: Column, x0: Column, bound: Column) -> Column:
    """Words of a line that stand in a label's column, up to a wide gap."""
    mine = F.filter(w, lambda x: (x["x0"] >= x0 - LEFT) & (bound.isNull() | (x["x0"] < bound - RIGHT)))
    wide = F.transform(mine, lambda x, i: (i > 0) & F.coalesce(x["x0"] - F.get(mine, i - 1)["x1"] > COLUMN_GAP, F.lit(False)))
    cut = F.array_position(wide, True)
    return bare(said(F.when(cut > 0, F.slice(mine, 1, (cut - 1).cast("int"))).otherwise(mine)))


def values(lines: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc, field, value): for each field the first label down the document that has a value, to its right or else in
    its column in the next two lines."""
    named: dict[str, list[str]] = {}
    for f, aliases in fields.items():
        for a in dict.fromkeys(map(plain, aliases)):
            named.setdefault(a, []).append(f)
    # A label's run begins with a word that some label begins with, or with one that has nothing that counts.
    openings = {first for a in (*WHOLE, *named) for first in (a.split() or [""])[:1]}
    part = lambda c: tidy(F.regexp_replace(F.lower(c), "[^a-z0-9/&. ]+", " "))
    run = lambda i, k: F.rtrim(F.array_join(F.filter(F.slice("parts", i + 1, k), lambda p: p != ""), " "), F.lit(" :."))
    opens = lambda p: (first := F.substring_index(p, " ", 1)).isin("", *openings) | F.rtrim(first, F.lit(".")).isin("", *openings)
    every = lambda p, i: F.when(opens(p), F.array(*(F.when(i + k <= F.size("parts"), F.struct(i.alias("at"), F.lit(k).alias("size"), F.get(F.col("w"), i)["x0"].alias("x0"), run(i, k).alias("key"))) for k in range(MOST, 0, -1))))
    parted = lines.select(*PAGE, "line", "w", F.transform("w", lambda x: part(x["text"])).alias("parts"), F.lead("w").over(down()).alias("w1"), F.lead("w", 2).over(down()).alias("w2"))
    known = parted.withColumn("runs", F.filter(F.flatten(F.filter(F.transform("parts", every), lambda r: r.isNotNull())), lambda r: r.isNotNull()))
    runs = known.withColumn("runs", F.filter("runs", lambda r: r["key"].isin(*WHOLE, *named)))
    heads = F.transform(F.filter("runs", lambda r: r["key"].isin(*WHOLE)), lambda r: F.struct(r["at"].alias("at"), r["x0"].alias("x0")))
    hits = runs.select(*PAGE, "line", "w", "w1", "w2", heads.alias("heads"), F.explode(F.filter("runs", lambda r: r["key"].isin(list(named)))).alias("r"))
    end = F.col("r.at") + F.col("r.size")
    bound = F.array_min(F.filter("heads", lambda h: h["at"] >= end))["x0"]
    said_ = hits.select(*PAGE, "line", "r", beside(F.col("w"), end).alias("a"), *(under(F.col(n), F.col("r.x0"), bound).alias(n) for n in ("w1", "w2")))
    value = F.coalesce(*(F.when(~is_label(F.col(c)), F.col(c)) for c in ("a", "w1", "w2")))
    order = F.struct("page", "line", F.col("r.at"), -F.col("r.size"))
    of = lookup({k: "\n".join(v) for k, v in named.items()})
    found = said_.select("doc", order.alias("o"), F.explode(F.split(of[F.col("r.key")], "\n")).alias("field"), value.alias("value"))
    return found.where("value is not null").groupBy("doc", "field").agg(F.min_by("value", "o").alias("value"))


def extras(lines: DataFrame, longest: int = 120) -> DataFrame:
    """(doc, field, value) of EXTRAS, shorter than longest, without letters that a font has no name for."""
    clean = F.regexp_replace(tidy(F.regexp_replace("value", r"\(cid:\d+\)", " ")), "^[ :&.-]+|[ :&.-]+$", "")
    return values(lines, EXTRAS).select("doc", "field", blank_to_null(clean).alias("value")).where(F.length("value") < longest)


def gaps(lines: DataFrame, captured: DataFrame) -> DataFrame:
    """(doc, field) of EXPECTED that the page has a value for and captured (doc, field) doesn't list."""
    return values(lines, EXPECTED).select("doc", "field").join(captured, ["doc", "field"], "left_anti")
