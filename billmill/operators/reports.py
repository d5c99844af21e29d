"""Ledger reports: filters, roll-ups, top-k, searches, pages and exports, as plans that Catalyst can push and prune.

Aggregates come before dimension joins: the few rows of a report meet the dimension, not the facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.bridge import counted

ROLES = ("seller", "buyer", "broker", "transporter")


def number(c: Column | str) -> Column:
    """A sum of decimals as a report shows it: a double, 0 for none."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("double")


def within(bills: DataFrame, date_from: str | None = None, date_to: str | None = None, fy: str | None = None) -> DataFrame:
    """Bills of a closed date range and a financial year; each is optional."""
    tests = [F.col("invoice_date") >= F.lit(date_from).cast("date")] * (date_from is not None) + [F.col("invoice_date") <= F.lit(date_to).cast("date")] * (date_to is not None) + [F.col("financial_year") == fy] * (fy is not None)
    return reduce(lambda df, t: df.where(t), tests, bills)


def rollup(bills: DataFrame, parties: DataFrame, role: str, limit: int = 100, **dates: str) -> DataFrame:
    """Turnover by the party in a role: the largest totals first, ties by id."""
    key = f"{role}_id"
    sums = within(counted(bills), **dates).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("party_id")).agg(
        F.count("*").alias("invoice_count"), F.sum("taxable_value").alias("t"), F.sum("grand_total").alias("g"), F.sum("amount_paid").alias("p"), F.max("invoice_date").alias("last_date"))
    top = sums.orderBy(F.desc_nulls_last("g"), "party_id").limit(limit)
    return top.join(parties.select("party_id", "legal_name"), "party_id", "left").select(
        "party_id", F.col("legal_name").alias("party"), "invoice_count", number("t").alias("taxable_value"), number("g").alias("grand_total"), number("p").alias("paid"),
        (F.coalesce("g", F.lit(0)) - F.coalesce("p", F.lit(0))).cast("decimal(38,2)").cast("double").alias("outstanding"), "last_date")


def product_report(lines: DataFrame, bills: DataFrame, products: DataFrame) -> DataFrame:
    """Volume, value and weighted average rate (half-even, none without a quantity) of each product."""
    ids = counted(bills).select(F.col("id").alias("invoice_id"))
    sums = lines.join(ids, "invoice_id").groupBy("product_id").agg(F.countDistinct("invoice_id").alias("invoice_count"), F.sum("quantity").alias("q"), F.sum("taxable_amount").alias("v"))
    rate = F.bround((F.col("v").cast("decimal(24,2)") / F.nullif(F.col("q"), F.lit(0)).cast("decimal(13,3)")).cast("decimal(38,10)"), 2)
    return sums.join(products.select("product_id", "name", "category"), "product_id").select("product_id", "name", "category", "invoice_count", number("q").alias("quantity"), number("v").alias("value"), rate.cast("double").alias("avg_rate"))


def summary(bills: DataFrame, entries: DataFrame, fy: str | None = None) -> DataFrame:
    """One row of totals. A tax column that is null counts as none beside the others. Brokerage is by the entry's own
    year and isn't gated by the bill's status."""
    zero = F.lit(0)
    tax = sum((F.coalesce(F.sum(c), zero) for c in ("cgst_amount", "sgst_amount", "igst_amount")), F.lit(0).cast("decimal(38,2)"))
    one = within(counted(bills), fy=fy).agg(F.count("*").alias("invoice_count"), F.sum("grand_total").alias("g"), F.sum("taxable_value").alias("t"), tax.alias("x"), F.sum("amount_paid").alias("p"), F.countDistinct("seller_id").alias("sellers"))
    earned = within(entries, fy=fy).agg(F.sum("amount").alias("b"))
    return one.crossJoin(earned).select("invoice_count", "sellers", number("g").alias("turnover"), number("t").alias("taxable"), number("x").alias("tax"), number("p").alias("paid"), (F.coalesce("g", zero) - F.coalesce("p", zero)).cast("double").alias("outstanding"), number("b").alias("brokerage"))


def status_histogram(bills: DataFrame, documents: DataFrame) -> DataFrame:
    b = bills.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("invoice").alias("kind"), "status", "n")
    return b.unionByName(documents.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("document").alias("kind"), "status", "n"))


def available_years(bills: DataFrame) -> DataFrame:
    return bills.select("financial_year").where("financial_year is not null").distinct().orderBy(F.desc("financial_year"))


def timeline(bills: DataFrame, entries: DataFrame) -> DataFrame:
    """Totals by calendar month, with the month's brokerage or 0."""
    month = F.date_format("invoice_date", "yyyy-MM")
    dated = counted(bills).where("invoice_date is not null")
    sums = dated.groupBy(month.alias("month"), F.date_format("invoice_date", "MMM yyyy").alias("label")).agg(F.count("*").alias("invoice_count"), F.sum("grand_total").alias("g"), F.sum("taxable_value").alias("t"))
    earned = entries.join(dated.select("id", "invoice_date"), F.col("invoice_id") == F.col("id")).groupBy(month.alias("month")).agg(F.sum("amount").alias("b"))
    return sums.join(earned, "month", "left").select("month", "label", "invoice_count", number("g").alias("turnover"), number("t").alias("taxable"), number("b").alias("brokerage"))


def party_profile(bills: DataFrame) -> DataFrame:
    """Totals of each party in each of its roles: one pass over the bills, each giving a row a role."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_id").cast("long").alias("party_id")) for r in ROLES)))
    rows = counted(bills).select(each.alias("r"), "grand_total", "taxable_value", "invoice_date").where("r.party_id is not null")
    return rows.groupBy("r.party_id", "r.role").agg(F.count("*").alias("invoice_count"), number(F.sum("grand_total")).alias("grand_total"), number(F.sum("taxable_value")).alias("taxable_value"), F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"))


def corrections(edits: DataFrame, limit: int = 50) -> DataFrame:
    """Where readings get corrected most; a missing format hint is named after grouping."""
    top = edits.groupBy("hint", "field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("hint"), "field").limit(limit)
    return top.select(F.coalesce(F.nullif(F.col("hint"), F.lit("")), F.lit("unknown")).alias("hint"), "field", "n")


def failed_documents(documents: DataFrame, limit: int = 200) -> DataFrame:
    """What couldn't be read at all, newest first: the other half of the queue."""
    return documents.where("status = 'failed'").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def review_queue(bills: DataFrame, flags: DataFrame, limit: int = 200) -> DataFrame:
    """Bills to look at: those without a confidence first, then by rising confidence; with counts of open flags."""
    top = bills.where("needs_review").orderBy(F.asc_nulls_first("confidence"), F.desc("id")).limit(limit)
    open_ = flags.groupBy("invoice_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    return top.join(open_, F.col("id") == F.col("invoice_id"), "left").select("id", "confidence", "status", F.coalesce("e", F.lit(0)).alias("errors"), F.coalesce("w", F.lit(0)).alias("warnings"))


def concentration(bills: DataFrame, parties: DataFrame, top: int = 4) -> DataFrame:
    """Shares of the largest sellers and of all others together: the few largest are found first, so only they are ranked."""
    sums = counted(bills).where("seller_id is not null").groupBy("seller_id").agg(F.sum("grand_total").alias("g"))
    largest = sums.orderBy(F.desc("g"), "seller_id").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("g"), "seller_id")))
    named = largest.join(parties.select(F.col("party_id").alias("seller_id"), "legal_name"), "seller_id", "left").select("rank", F.col("legal_name").alias("name"), "g")
    total = sums.agg(F.sum("g").alias("all"), F.count("*").alias("n"))
    rest = total.crossJoin(largest.agg(F.sum("g").alias("top"))).where(F.col("n") > top).select(F.lit(top + 1).alias("rank"), F.lit("Everyone else").alias("name"), (F.col("all") - F.col("top")).alias("g"))
    share = F.bround((F.col("g").cast("decimal(30,2)") * 100 / F.col("all").cast("decimal(24,2)")).cast("decimal(38,8)"), 1)
    rows = named.unionByName(rest).crossJoin(total.select("all"))  # five rows and one
    return rows.select(F.col("rank").cast("long").alias("rank"), "name", number("g").alias("turnover"), share.cast("double").alias("share"))


def kpis(bills: DataFrame, entries: DataFrame) -> DataFrame:
    """Average bill and brokerage as a percentage of what was taxed; 0 where there is nothing to divide by."""
    one = counted(bills).agg(F.count("*").alias("n"), F.sum("grand_total").alias("g"), F.sum("taxable_value").alias("t")).crossJoin(entries.agg(F.sum("amount").alias("b")))
    part = lambda a, b: F.coalesce(F.bround((F.col(a).cast("decimal(24,2)") * F.lit(100) / F.nullif(F.col(b), F.lit(0)).cast("decimal(24,2)")).cast("decimal(38,8)"), 4), F.lit(0)).cast("double")
    average = F.coalesce(F.bround((F.col("g").cast("decimal(24,2)") / F.nullif(F.col("n"), F.lit(0)).cast("decimal(18,0)")).cast("decimal(38,8)"), 2), F.lit(0)).cast("double")
    return one.select(average.alias("average_bill"), part("b", "t").alias("brokerage_pct"))


ORDERS = {
    "date_desc": [F.desc_nulls_last, "invoice_date"], "date_asc": [F.asc_nulls_first, "invoice_date"], "amount_desc": [F.desc_nulls_last, "grand_total"], "amount_asc": [F.asc_nulls_first, "grand_total"], "recent": [F.desc, "id"],
}


def page(bills: DataFrame, sort: str = "date_desc", limit: int = 100, offset: int = 0, **equal: object) -> DataFrame:
    """A page of the bills that equal the given values (a falsy one filters nothing), ties by falling id."""
    rows = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] else df, equal.items(), bills)
    how, name = ORDERS.get(sort, ORDERS["date_desc"])
    return rows.orderBy(how(name), F.desc("id")).offset(offset).limit(limit)


def page_totals(rows: DataFrame) -> DataFrame:
    """What a page's rows add up to: the page, not the table."""
    return rows.agg(F.count("*").alias("n"), number(F.sum("grand_total")).alias("grand_total"), number(F.sum("taxable_value")).alias("taxable_value"))


def search(bills: DataFrame, parties: DataFrame, q: str) -> DataFrame:
    """Bills whose number, year, status or raw broker has q in it, or whose seller's or buyer's name has; % and _ in q
    stand for what they do in LIKE, and case doesn't count."""
    like = f"%{q.strip()}%"
    named = parties.where(F.col("legal_name").ilike(like)).select("party_id").distinct()
    s, b = (named.select(F.col("party_id").alias(f"{r}_hit")) for r in ("seller", "buyer"))
    rows = bills.join(s, F.col("seller_id") == F.col("seller_hit"), "left").join(b, F.col("buyer_id") == F.col("buyer_hit"), "left")
    own = reduce(lambda x, y: x | y, (F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in ("invoice_number", "financial_year", "status", "broker_name_raw")))
    return rows.where(own | F.col("seller_hit").isNotNull() | F.col("buyer_hit").isNotNull()).drop("seller_hit", "buyer_hit")


def party_search(parties: DataFrame, role: str, q: str, limit: int = 50) -> DataFrame:
    """Parties of a role with q in their name, number or city, by name."""
    like = f"%{q.strip()}%"
    fits = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in ("legal_name", "gstin", "city") if c in parties.columns))
    return parties.where((F.col("role") == role) & fits).orderBy("legal_name", "party_id").limit(limit)


def holdout(rows: DataFrame, id_col: str, share: float = 0.85) -> DataFrame:
    """A training and a test part: the first 85 % by id (nulls last), one row at least, train. Rows are sorted into ranges
    of ids; a range is numbered from the count of those before it, which are as many numbers as partitions. The ranges
    follow from a sample that is drawn anew each time they are made, so they are made once, and kept on the executors."""
    order = F.asc_nulls_last(id_col)
    ranged = rows.select(id_col).repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)).localCheckpoint()
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, {}
    for part in sorted(sizes):
        starts[part], before = before, before + sizes[part]
    if not starts:
        return rows.select(id_col, F.lit("train").alias("part"))
    train = max(1, int(before * round(share * 100)) // 100)
    first = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[F.col("_p")]
    return ranged.select(id_col, F.when(first + F.col("_i") < train, "train").otherwise("test").alias("part"))


def terms(rows: DataFrame, columns: list[str], limit: int | None = 40) -> DataFrame:
    """Names in use with how often, most used first; short ones and ones with a digit don't count."""
    each = rows.select(F.explode(F.array(*(F.trim(c) for c in columns))).alias("term")).where((F.length("term") >= 3) & ~F.col("term").rlike(r"(?U)\d"))
    out = each.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term")
    return out.limit(limit) if limit else out.select("term").orderBy("term")
