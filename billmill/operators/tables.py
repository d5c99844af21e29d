"""What a bill's page says by where its words stand: the goods table, the totals under it, the tax table, the total in words.

Input is words with line (layout.lines). A line is one array of its words, all else is expressions and windows over lines.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from ..functions.cleaning import blank_to_null, lookup
from ..functions.printed import figure
from .documents import row_class, unglued
from .layout import PAGE, page_lines

# What columns are called, in the order that a row's label is read in; how tables end; forms of cells.
COLUMNS = {
    "serial": ("sl no", "sr no", "s n", "s no", "sl", "sr", "sn", "no"),
    "description": ("code & description of goods", "name of product/service", "description of goods", "description of good", "name of product", "particulars", "description", "product", "goods", "item"),
    "item_remarks": ("item remarks", "remarks"), "hsn": ("hsn/sac code", "hsn/sac", "hsn code", "hsn", "sac"), "bags": ("bag qty", "alt quantity", "bags", "packages"), "quantity": ("quantity", "qty"),
    "rate": ("rate", "price"), "rate_uom": ("per", "unit"), "discount": ("disc %", "discount", "disc"), "tax_rate": ("tax rate",), "tax_amount": ("tax amt", "tax amount"), "amount": ("amount", "value"),
}
END = r"(?i)^(total|grand total|sub\s*total|amount chargeable|e\. ?& ?o\.e|continued|subject to|company'?s? bank|bank details)\b"
ANNEXURE = r"(?i)^e-?way\s*bill\b"
NUMBER = r"^\(?-?[\d,]+(?:\.\d+)?\)?$"
AMOUNT = r"(?i)^[₹Rs.\s]*\(?-?\)?\s*-?(?=.*\d)[\d,]+(?:\.\d+)?\)?\s*(cr|dr)?$"
FIGURE = r"(?i)^(?=.*\d)[₹Rs\s.,()%+-]*[\d,.]+\s*%?\s*(cr|dr)?$"
LEADING_SERIAL = r"^(\d{1,3})\s+(?=[A-Za-z])"
BAG_UNIT, WEIGHT_UNIT = r"(?i)\b(bags?|pkts?|cartons?|boxes)\b", r"(?i)\b(kgs?|mt|qtl|ltr?|gms?|pcs|nos)\b"
BAG_LINE = r"(?i)^([\d,]+)\s*(bags?|pkts?|packets?|cartons?|boxes|tins?|drums?)$"
# Labels of totals, other labels that end a figure's span, labels and words of a total in words, tax heads.
TOTALS = {
    "taxable_value": ("taxable value", "total taxable", "taxable amt", "tot.taxable amt", "taxable"), "cgst_amount": ("cgst",), "sgst_amount": ("sgst", "utgst", "sgst/utgst"), "igst_amount": ("igst",), "cess_amount": ("cess",),
    "tcs_amount": ("tcs",), "round_off": ("round off", "r/off", "rounded off", "roundoff"), "grand_total": ("grand total", "total inv amt", "total amount", "total"),
}
OTHER_LABELS = ("other amt", "rate", "amount", "tax amount", "tax rate", "value", "qty", "quantity", "igst amt", "cgst amt", "sgst amt", "total tax", "e. & o.e")
IN_WORDS = r"amount chargeable \(in words\)|amount chargeable|amount in words|amount ?\(in words\)|rupees in words"
TAX_IN_WORDS = r"tax amount \(in words\)|tax amt in words|tax amount in words"
LABEL_OF_WORDS = r"(?i)amount[^:]*?(?:\(in words\)|in words|chargeable)\s*:?"
SPELLED = "lakh|thousand|crore|hundred|only"
HEADS = {"cgst": "cgst", "sgst": "sgst", "utgst": "sgst", "igst": "igst", "cess": "cess"}
PRINTED = r"\(?-?\)?\s*₹?\s*-?\d[\d,]*(?:\.\d+)?\)?"
HSN_ROW = r"^(\d{4}(?:\d{2}(?:\d{2})?)?)\b"

#: Columns that make a heading; points between a heading's two lines, and between two columns of running text.
LEAST, FOLD, COLUMN_GAP = 3, 20.0, 25.0
#: Letters that a goods line's description has room for.
WIDTH = 200


def down() -> WindowSpec:
    """A page's lines from top to bottom."""
    return Window.partitionBy(*PAGE).orderBy("line")


def tidy(c: Column) -> Column:
    """With one space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def by_line(words: DataFrame) -> DataFrame:
    """(doc, page, line, y, w, text): a row a line, w its words (x0, x1, text) from left to right."""
    w = F.array_sort(F.collect_list(F.struct("x0", "x1", F.coalesce("text", F.lit("")).alias("text"))))
    return words.groupBy(*PAGE, "line").agg(F.avg("y").alias("y"), w.alias("w")).withColumn("text", said(F.col("w")))


def page_by_line(words: DataFrame) -> DataFrame:
    """by_line(layout.lines(words)), with the words shuffled once."""
    y = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["y"].cast("double")) / F.size("w")
    w = F.array_sort(F.transform("w", lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"), F.coalesce(x["text"], F.lit("")).alias("text"))))
    return page_lines(words).select(*PAGE, "line", y.alias("y"), w.alias("w")).withColumn("text", said(F.col("w")))


def said(w: Column) -> Column:
    return F.array_join(F.transform(w, lambda x: x["text"]), " ")


def labelled(lines: DataFrame, names: dict[str, str], clean: Callable[[Column], Column]) -> DataFrame:
    """lines with labels, an array (at, size, name, x0, x1): from left to right the longest run of words that names has.

    What starts at each word is looked up first, where a name starts with that word (or the word has nothing that
    counts; clean has to clean word by word and to keep letters and digits); a fold then leaves out what an earlier
    label covers.
    """
    w, longest, openings = F.col("w"), max(len(n.split()) for n in names), {n.split()[0] for n in names}
    others = sorted({*ascii_lowercase, *digits} - {o[0] for o in openings})  # most words are told by their first letter

    def starting(x: Column, i: Column) -> Column:
        named = lambda k: lookup(names)[clean(said(F.slice(w, i + 1, k)))]
        runs = [F.when((i + k <= F.size(w)) & named(k).isNotNull(), F.struct(i.alias("at"), F.lit(k).alias("size"), named(k).alias("name"), x["x0"].alias("x0"), F.get(w, i + k - 1)["x1"].alias("x1"))) for k in range(longest, 0, -1)]
        begins = F.substring_index(clean(x["text"]), " ", 1).isin("", *openings)
        return F.when(~F.lower(F.left(x["text"], F.lit(1))).isin(*others) & begins, F.coalesce(*runs))

    shape = "array<struct<at:int,size:int,name:string,x0:double,x1:double>>"
    kept = lambda a, s: F.when(s.isNull() | (s["at"] < a["free"]), a).otherwise(F.struct((s["at"] + s["size"]).alias("free"), F.concat(a["out"], F.array(s)).alias("out")))
    found = lines.withColumn("labels", F.transform("w", starting).cast(shape))
    return found.withColumn("labels", F.aggregate("labels", F.struct(F.lit(0).alias("free"), F.array().cast(shape).alias("out")), kept, lambda a: a["out"]))


def without_annexures(lines: DataFrame, looked_at: int = 4) -> DataFrame:
    """lines of pages other than e-way bills, which say so within the first lines and list the goods once more."""
    other = lines.where((F.col("line") < looked_at) & F.trim("text").rlike(ANNEXURE)).select(*PAGE).distinct()
    return lines.join(other, PAGE, "left_anti")


def headings(lines: DataFrame, columns: dict[str, tuple[str, ...]] = COLUMNS) -> DataFrame:
    """(doc, page, line, last, y, columns): the line with the most column names, the upper of equals, LEAST at least.

    A line close below with some names, but no more, belongs to it, so last may be the next line. columns is an array
    (x0, x1, name) from left to right.
    """
    clean = lambda c: tidy(F.replace(F.regexp_replace(F.lower(c), "[^a-z0-9/&% ]+", " "), F.lit("%"), F.lit(" ")))
    names = {" ".join(a.replace("%", " ").split()): n for n, aliases in columns.items() for a in aliases}
    of = lambda c: F.transform(c, lambda x: x["name"])
    first = F.filter("labels", lambda h, i: F.array_position(of(F.col("labels")), h["name"]) == i + 1)
    named = labelled(lines, names, clean).select(*PAGE, "line", "y", F.transform(first, lambda h: F.struct(h["x0"].alias("x0"), h["x1"].alias("x1"), h["name"].alias("name"))).alias("c"))
    near = named.withColumns({"d": F.lead("c").over(down()), "dy": F.lead("y").over(down()) - F.col("y")}).where(F.size("c") >= LEAST)
    folds = F.coalesce(F.size("d").between(1, F.size("c")) & (F.abs("dy") < FOLD), F.lit(False))
    more = F.filter("d", lambda x: ~F.array_contains(of(F.col("c")), x["name"]))
    both = F.array_sort(F.when(folds, F.concat("c", more)).otherwise(F.col("c"))).alias("columns")
    whole = near.select(*PAGE, F.struct("line", (F.col("line") + folds.cast("long")).alias("last"), "y", both).alias("h"), F.struct(F.size("c"), -F.col("line")).alias("o"))
    return whole.groupBy(*PAGE).agg(F.max_by("h", "o").alias("h")).select(*PAGE, "h.*")


def rows(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """The goods table's rows: doc, page, row (from 1), y, a string for each of COLUMNS, extra, class.

    A word is of the column that its middle is in; columns part half-way between two headings. A line with a serial
    number or an amount opens a row. Others belong to the row above: their descriptions are extra, in order, and their
    further cells fill blanks. The table ends at a line that starts with a word of END; what is above the first row is
    no row. Pages without a heading have none. Every row is kept, however many there are.
    """
    parts = F.transform(F.slice("columns", 2, F.greatest(F.size("columns") - 1, F.lit(0))), lambda c, i: (F.get(F.col("columns"), i)["x1"] + c["x0"]) / 2)
    known = heads.select(*PAGE, "last", F.transform("columns", lambda c: c["name"]).alias("names"), parts.alias("parts"))
    ends = F.get(F.col("w"), F.lit(0))["text"].rlike(END) | said(F.slice("w", 1, 2)).rlike(END)
    below = lines.join(known, PAGE).where("line > last").withColumn("ended", F.max(ends).over(down())).where("not ended")
    at = lambda x: F.get(F.col("names"), F.size(F.filter("parts", lambda p: p < (x["x0"] + x["x1"]) / 2)))
    celled = below.withColumn("b", F.transform("w", lambda x: F.struct(at(x).alias("name"), x["text"].alias("text"))))
    of = lambda n: lambda x: x["name"] == n
    celled = celled.select(*PAGE, "line", "y", *(F.trim(said(F.filter("b", of(n)))).alias(n) for n in COLUMNS))

    parted = celled.withColumn("u", unglued(F.col("serial"), F.col("description"))).withColumns({"serial": F.col("u.serial"), "description": F.col("u.description")}).drop("u")
    paid = F.col("amount").rlike(AMOUNT)
    drifted = (F.col("serial") == "") & paid & F.col("description").rlike(LEADING_SERIAL)
    own = parted.withColumns({"serial": F.when(drifted, F.regexp_extract("description", LEADING_SERIAL, 1)).otherwise(F.col("serial")), "description": F.when(drifted, F.regexp_replace("description", LEADING_SERIAL, "")).otherwise(F.col("description"))})
    opened = own.withColumn("opens", paid | F.col("serial").rlike(NUMBER))
    numbered = opened.withColumn("row", F.sum(F.col("opens").cast("long")).over(down())).where("row > 0")

    beneath = F.trim(F.concat_ws(" ", F.nullif("description", F.lit("")), F.nullif("item_remarks", F.lit(""))))
    words = ("description", "item_remarks")
    value = lambda n: F.min_by(n, "line") if n in words else F.min_by(n, F.when(F.col(n) != "", F.col("line")))
    extra = F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens") & (beneath != ""), F.struct("line", beneath.alias("t"))))), lambda e: e["t"])
    table = numbered.groupBy(*PAGE, "row").agg(F.min_by("y", "line").alias("y"), *(F.coalesce(value(n), F.lit("")).alias(n) for n in COLUMNS), extra.alias("extra"))
    swapped = F.col("quantity").rlike(BAG_UNIT) & ~F.col("quantity").rlike(WEIGHT_UNIT) & F.col("bags").rlike(WEIGHT_UNIT)
    table = table.withColumns({"quantity": F.when(swapped, F.col("bags")).otherwise(F.col("quantity")), "bags": F.when(swapped, F.col("quantity")).otherwise(F.col("bags"))})
    labels = [F.when(~F.col(n).rlike(FIGURE), F.nullif(n, F.lit(""))) for n in COLUMNS if n != "amount"]
    label = F.coalesce(tidy(F.concat_ws(" ", *labels, F.array_join("extra", " "))), F.lit(""))
    return table.withColumn("class", row_class(label, F.col("quantity"), F.col("amount")))


def beneath(description: Column, remarks: Column, extra: Column) -> Column:
    """(description, bags, brand) of a goods row: the first line beneath it that counts packages, the first short one
    without a digit, and a description that has the others as well."""
    lines = F.filter(F.transform(extra, tidy), lambda t: (t != "") & ~t.eqNullSafe(remarks))
    spot = lambda test: F.array_position(F.transform(lines, test), True)
    bags, brand = spot(lambda t: t.rlike(BAG_LINE)), spot(lambda t: (F.length(t) <= 40) & ~t.rlike(r"(?U)\d"))
    rest = F.filter(lines, lambda t, i: (i + 1 != bags) & (i + 1 != brand))
    counted = F.regexp_replace(F.regexp_extract(F.get(lines, (bags - 1).cast("int")), BAG_LINE, 1), ",", "").try_cast("double")
    whole = blank_to_null(F.left(tidy(F.concat_ws(" ", description, F.array_join(rest, " "))), F.lit(WIDTH)))
    return F.struct(whole.alias("description"), F.when(bags > 0, counted).alias("bags"), F.when(brand > 0, F.get(lines, (brand - 1).cast("int"))).alias("brand"))


def totals(lines: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """(doc, field, value): figures with a label of TOTALS; of several, the last one down the document.

    A figure belongs to the label before it, and of the figures up to the next label the last counts, since a rate is
    printed before its amount. With below (doc, page, y), lines above y on that page don't count.
    """
    clean = lambda c: tidy(F.regexp_replace(F.lower(c), "[^a-z0-9./ ]+", " "))
    fields = {a: f for f, aliases in TOTALS.items() for a in aliases}
    if below is not None:
        lines = lines.join(below.select(*PAGE, F.col("y").alias("_y")), PAGE, "left").where("_y is null or y >= _y").drop("_y")
    spans = labelled(lines, {n: n for n in [*fields, *OTHER_LABELS]}, clean).select(*PAGE, "line", "w", "labels", F.posexplode_outer("labels").alias("k", "l")).where("l is not null")  # a plain one would look labels up twice
    start = F.col("l.at") + F.col("l.size")
    stop = F.coalesce(F.get(F.col("labels"), F.col("k") + 1)["at"], F.size("w"))
    figures = F.filter(F.transform(F.slice("w", start + 1, stop - start), lambda x: figure(x["text"])), lambda v: v.isNotNull())
    valued = spans.select(*PAGE, "line", "k", lookup(fields)[F.col("l.name")].alias("field"), F.element_at(F.when(F.size(figures) > 0, figures), -1).alias("value"))
    return valued.where("field is not null and value is not null").groupBy("doc", "field").agg(F.max_by("value", F.struct("page", "line", -F.col("k"))).alias("value"))


def in_words(lines: DataFrame) -> DataFrame:
    """(doc, words): the first total that is spelled out, after its label or in the leftmost column of the three lines
    below; amounts of tax aren't it."""
    spelled = lambda c: F.coalesce(F.lower(c).rlike(SPELLED) & (F.regexp_count(c, F.lit("[A-Za-z]{3,}")) >= 3), F.lit(False))
    gap = F.transform("w", lambda x, i: F.coalesce(x["x0"] - F.get(F.col("w"), i - 1)["x1"] > COLUMN_GAP, F.lit(False)) & (i > 0))
    cut = F.array_position(gap, True)
    run = F.nullif(F.trim(said(F.when(cut > 0, F.slice("w", 1, (cut - 1).cast("int"))).otherwise(F.col("w")))), F.lit(""))
    low = tidy(F.lower("text"))
    seen = lines.withColumn("run", run).withColumns({f"r{k}": F.lead("run", k).over(down()) for k in (1, 2, 3)}).where(low.rlike(IN_WORDS) & ~low.rlike(TAX_IN_WORDS))
    tail = F.regexp_replace(F.element_at(F.split("text", LABEL_OF_WORDS), -1), "^[ :]+|[ :]+$", "")
    tail = F.when(F.col("text").rlike(LABEL_OF_WORDS), tail)
    upto = [F.concat_ws(" ", *(f"r{j}" for j in range(1, k + 1))) for k in (1, 2, 3)]
    found = F.coalesce(F.when(spelled(tail), tail), *(F.when(spelled(u) & u.rlike(r"(?i)\bonly\b"), u) for u in upto), F.when(spelled(upto[2]), upto[2]))
    bare = F.regexp_replace(tidy(found), "^[ :]+|[ :]+$", "")
    return seen.select(*PAGE, "line", bare.alias("words")).where("words is not null").groupBy("doc").agg(F.min_by("words", F.struct("page", "line")).alias("words"))


def tax_rows(lines: DataFrame) -> DataFrame:
    """(doc, page, line, hsn, taxable_value, taxes, total_tax): lines that start with a goods code and have a taxable
    value, then a rate and an amount for each tax, then perhaps their sum. taxes is an array (head, rate, amount).

    Which taxes, the heading says: the nearest line with 'taxable' and names of taxes in the six lines above the page's
    first row. Without one, the page has no rows.
    """
    letters = lambda x: F.regexp_replace(F.lower(x["text"]), "[^a-z]", "")
    head = lambda t: F.coalesce(*(F.when(t.startswith(h), F.lit(n)) for h, n in HEADS.items()))
    named = F.array_distinct(F.filter(F.transform("w", lambda x: head(letters(x))), lambda n: n.isNotNull()))
    above = F.last(F.when(F.lower("text").contains("taxable") & (F.size(named) > 0), named), ignorenulls=True).over(down().rowsBetween(-6, -1))
    figures = F.filter(F.transform(F.regexp_extract_all("text", F.lit(PRINTED), F.lit(0)), figure), lambda v: v.isNotNull())
    values = F.slice(figures, 2, F.greatest(F.size(figures) - 1, F.lit(0)))
    like = lines.select(*PAGE, "line", above.alias("above"), F.regexp_extract(F.trim("text"), HSN_ROW, 1).alias("hsn"), values.alias("v")).where("hsn <> '' and size(v) >= 2")
    ready = like.withColumn("heads", F.first("above").over(down())).where("heads is not null and size(v) >= 1 + 2 * size(heads)")
    v = lambda i: F.get(F.col("v"), i)
    taxes = F.transform("heads", lambda h, i: F.struct(h.alias("head"), v(2 * i + 1).alias("rate"), v(2 * i + 2).alias("amount")))
    return ready.select(*PAGE, "line", "hsn", v(F.lit(0)).alias("taxable_value"), taxes.alias("taxes"), v(2 * F.size("heads") + 1).alias("total_tax"))
