"""Brokerage: the most specific rule of each bill, by joins on the keys that a rule names, and what it earns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("seller_id", "buyer_id")
#: Rules beyond this many aren't broadcast; the join is by shuffle then.
BROADCAST_RULES = 10_000


def best_rules(bills: DataFrame, rules: DataFrame, lines: DataFrame) -> DataFrame:
    """(invoice_id, rule_id) of the rule with the highest score (seller 4, buyer 4, product 2, code 1), then the least id.

    A null in a rule (or a code that is empty) matches anything; dates are a closed window, which a bill without a date
    passes. A rule for a product or a code (hsn, of which rules and lines may have none) matches bills with a line of
    it, the two not always of one line: those pairs come from equi-joins with the lines. Other rules are few
    (their count is checked): they are broadcast, or, beyond BROADCAST_RULES, met by key, one join for each set of keys.
    """
    window = (F.col("invoice_date").isNull()) | ((F.coalesce(F.col("date_from") <= F.col("invoice_date"), F.lit(True))) & (F.coalesce(F.col("date_to") >= F.col("invoice_date"), F.lit(True))))
    score = sum((F.when(F.col(f"r_{k}").isNotNull(), 4).otherwise(0) for k in KEYS), F.lit(0)) + F.when(F.col("r_product_id").isNotNull(), 2).otherwise(0) + F.when(F.col("r_hsn").isNotNull(), 1).otherwise(0)
    code = lambda df: F.nullif(F.col("hsn"), F.lit("")) if "hsn" in df.columns else F.lit(None).cast("string")
    named = rules.select("rule_id", code(rules).alias("r_hsn"), *(F.nullif(F.col(k), F.lit(0)).alias(f"r_{k}") for k in (*KEYS, "product_id")), F.col("effective_from").alias("date_from"), F.col("effective_to").alias("date_to"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    small = F.broadcast if few else (lambda df: df)
    slim = bills.select(F.col("id").alias("invoice_id"), *KEYS, "invoice_date")
    lines = lines.withColumn("hsn", code(lines))
    wanted = lines.join(small(named.where("r_product_id is not null").select("r_product_id").distinct()), F.col("product_id") == F.col("r_product_id"), "left_semi").select("invoice_id", "product_id").distinct()
    fits = window
    for k in KEYS:
        fits = fits & (F.col(f"r_{k}").isNull() | (F.col(f"r_{k}") == F.col(k)))
    with_product = slim.join(wanted, "invoice_id").join(small(named.where("r_product_id is not null")), (F.col("r_product_id") == F.col("product_id")) & fits)
    of_code = named.where("r_hsn is not null")
    coded = lines.join(small(of_code.select("r_hsn").distinct()), F.col("hsn") == F.col("r_hsn"), "left_semi").select("invoice_id", "hsn").distinct()
    both = with_product.where("r_hsn is not null").join(coded.withColumnRenamed("invoice_id", "_i"), (F.col("invoice_id") == F.col("_i")) & (F.col("r_hsn") == F.col("hsn")))
    with_code = slim.join(coded, "invoice_id").join(small(of_code.where("r_product_id is null")), (F.col("r_hsn") == F.col("hsn")) & fits)
    parts = [x.select("invoice_id", "rule_id", score.alias("score")) for x in (with_product.where("r_hsn is null"), both, with_code)]
    for present in ((), ("seller_id",), ("buyer_id",), KEYS):
        chosen = named.where(F.col("r_product_id").isNull() & F.col("r_hsn").isNull())
        for k in KEYS:
            chosen = chosen.where(F.col(f"r_{k}").isNotNull() if k in present else F.col(f"r_{k}").isNull())
        on = window
        for k in present:
            on = on & (F.col(k) == F.col(f"r_{k}"))
        parts.append(slim.join(small(chosen), on).select("invoice_id", "rule_id", score.alias("score")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("invoice_id").agg(F.min_by("rule_id", F.struct(-F.col("score"), F.col("rule_id"))).alias("rule_id"))


def accrued(bills: DataFrame, rules: DataFrame, lines: DataFrame, default_pct: str = "1.0") -> DataFrame:
    """(invoice_id, rule_id, basis_amount, amount, payable_by) of each bill, rounded half-even; the seller pays unless the
    rule says who does.

    A basis of 0 or null falls back to the taxable value, then to the grand total; a rule with a rate a unit, and a
    bill with a quantity, pay that; no rule pays the default percentage.
    """
    best = best_rules(bills, rules, lines).join(rules.select("rule_id", "basis", "pct", "rate_per_unit", (F.nullif(F.col("payable_by"), F.lit("")) if "payable_by" in rules.columns else F.lit(None).cast("string")).alias("payer")), "rule_id")
    rows = bills.join(best, F.col("id") == F.col("invoice_id"), "left")
    set_ = lambda c: F.nullif(F.col(c), F.lit(0))
    chosen = F.when(F.col("basis") == "grand_total", set_("grand_total")).when(F.col("basis") == "subtotal", set_("subtotal") if "subtotal" in bills.columns else F.lit(None)).otherwise(set_("taxable_value"))
    basis = F.coalesce(chosen, set_("taxable_value"), F.col("grand_total"), F.lit(0)).cast("decimal(18,2)")
    pct = F.coalesce("pct", F.lit(default_pct)).cast("decimal(9,4)")
    per_unit = F.bround((F.nullif(F.col("rate_per_unit"), F.lit(0)).cast("decimal(9,4)") * F.nullif(F.col("total_quantity"), F.lit(0)).cast("decimal(18,3)")).cast("decimal(28,7)"), 2)
    share = F.bround((basis * pct * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(34,8)"), 2)
    return rows.select(F.col("id").alias("invoice_id"), "rule_id", basis.alias("basis_amount"), F.coalesce(per_unit, share).cast("decimal(18,2)").alias("amount"), "financial_year", F.coalesce("payer", F.lit("seller")).alias("payable_by"))


def open_entries(entries: DataFrame, settled: DataFrame) -> DataFrame:
    """Entries that may be computed anew: settled ones never are."""
    return entries.join(settled, "invoice_id", "left_anti")
