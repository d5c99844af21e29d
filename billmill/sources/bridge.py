"""The ledger over the driver's tables: bills, goods lines, parties and products as DataFrames, and the same in SQL.

Amounts are doubles at the source and decimals from here on; they are summed as decimals and become doubles in a
report's last projection only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

COUNTED = ("extracted", "needs_review", "confirmed")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def financial_year(d: Column) -> Column:
    """'2026-27' for dates from April 2026 to March 2027."""
    start = F.year(d) - F.when(F.month(d) < 4, 1).otherwise(0)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, line_no, product_id, supplier_id, quantity, rate, discount_pct, taxable_amount, tax_amount."""
    src = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    one = F.lit(1).cast("decimal(9,4)")
    net = money(money(F.col("l_extendedprice")) * (one - F.col("l_discount").cast("decimal(9,4)")))
    out = src.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.row_number().over(order).cast("long").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").cast("decimal(18,3)").alias("quantity"),
        F.col("l_discount").cast("decimal(9,4)").alias("discount"),
        money(F.col("l_extendedprice")).alias("gross"),
        net.alias("taxable_amount"),
        money(net * F.col("l_tax").cast("decimal(9,4)")).alias("tax_amount"),
    )
    return out


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines without line_no: no sort for what only adds up."""
    one = F.lit(1).cast("decimal(9,4)")
    net = money(money(F.col("l_extendedprice")) * (one - F.col("l_discount").cast("decimal(9,4)")))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").cast("decimal(18,3)").alias("quantity"),
        net.alias("taxable_amount"), money(net * F.col("l_tax").cast("decimal(9,4)")).alias("tax_amount"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a bill; line sums come from one aggregate before the join, so bills without lines stay."""
    sums = plain_lines(spark, sf_dir).groupBy("invoice_id").agg(F.min("supplier_id").alias("seller_id"), money(F.sum("taxable_amount")).alias("taxable_value"), money(F.sum("tax_amount")).alias("tax_total"), F.sum("quantity").cast("decimal(18,3)").alias("total_quantity"))
    o = read(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("invoice_id"), "left")
    key, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    half = money(F.col("tax_total") * F.lit("0.5").cast("decimal(3,2)"))
    total = money(F.col("o_totalprice"))
    return o.select(
        key.alias("id"), "seller_id", (F.lit(1000000) + cust).alias("buyer_id"),
        F.when(cust % 9 != 0, 2000000 + cust % 9).alias("broker_id"), F.when(key % 11 != 0, 3000000 + key % 11).alias("transporter_id"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "rejected").when(key % 5 == 0, "needs_review").otherwise("extracted").alias("status"),
        day.alias("invoice_date"), financial_year(day).alias("financial_year"), F.concat(F.lit("INV-"), (cust % 50).cast("string")).alias("invoice_number"),
        "taxable_value", "total_quantity", F.when(key % 2 == 0, half).alias("cgst_amount"), F.when(key % 2 == 0, half).alias("sgst_amount"), F.when(key % 2 == 1, F.col("tax_total")).alias("igst_amount"),
        total.alias("grand_total"), F.when(key % 3 == 0, total).otherwise(money(F.lit(0))).alias("amount_paid"),
        F.when(key % 13 != 0, (key % 100) / 100).alias("confidence"), F.when(key % 7 == 0, "broker").otherwise(F.lit("")).alias("broker_name_raw"), (key % 4 == 0).alias("needs_review"),
    )


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers with their nation as state, and synthetic brokers and transporters."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("city"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("legal_name"), F.col("s_nationkey").alias("nk"), F.lit("seller").alias("role"))
    c = read(spark, sf_dir, "customer").select((1000000 + F.col("c_custkey")).alias("party_id"), F.col("c_name").alias("legal_name"), F.col("c_nationkey").alias("nk"), F.lit("buyer").alias("role"))
    made = [spark.range(1, n).select((base + F.col("id")).alias("party_id"), F.concat(F.lit(name), F.col("id").cast("string")).alias("legal_name"), F.lit(None).cast("int").alias("nk"), F.lit(role).alias("role")) for base, n, name, role in ((2000000, 9, "Broker ", "broker"), (3000000, 11, "Transporter ", "transporter"))]
    return s.unionByName(c).join(nation, "nk", "left").select("party_id", "legal_name", "city", F.lpad(F.col("nk").cast("string"), 2, "0").alias("state_code"), "role").unionByName(made[0].unionByName(made[1]).select("party_id", "legal_name", F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state_code"), "role"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("hsn"))


def counted(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isin(*COUNTED))


#: The same views for the oracle, as the head of a query.
SQL = """
WITH RECURSIVE lines AS (
  SELECT l_orderkey AS invoice_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)::BIGINT AS line_no,
    l_partkey AS product_id, l_suppkey AS supplier_id, l_quantity::DECIMAL(18,3) AS quantity, l_discount::DECIMAL(9,4) AS discount, l_extendedprice::DECIMAL(18,2) AS gross,
    (l_extendedprice::DECIMAL(18,2) * (1::DECIMAL(9,4) - l_discount::DECIMAL(9,4)))::DECIMAL(18,2) AS taxable_amount,
    ((l_extendedprice::DECIMAL(18,2) * (1::DECIMAL(9,4) - l_discount::DECIMAL(9,4)))::DECIMAL(18,2) * l_tax::DECIMAL(9,4))::DECIMAL(18,2) AS tax_amount
  FROM lineitem
),
sums AS (SELECT invoice_id, min(supplier_id) AS seller_id, sum(taxable_amount)::DECIMAL(18,2) AS taxable_value, sum(tax_amount)::DECIMAL(18,2) AS tax_total, sum(quantity)::DECIMAL(18,3) AS total_quantity FROM lines GROUP BY 1),
dated AS (SELECT *, o_orderdate::DATE AS d, year(o_orderdate) - (month(o_orderdate) < 4)::INT AS fy FROM orders),
invoices AS (
  SELECT o_orderkey AS id, seller_id, 1000000 + o_custkey AS buyer_id, CASE WHEN o_custkey % 9 <> 0 THEN 2000000 + o_custkey % 9 END AS broker_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN 3000000 + o_orderkey % 11 END AS transporter_id,
    CASE WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN o_orderstatus = 'P' THEN 'rejected' WHEN o_orderkey % 5 = 0 THEN 'needs_review' ELSE 'extracted' END AS status,
    d AS invoice_date, fy || '-' || lpad(((fy + 1) % 100)::VARCHAR, 2, '0') AS financial_year, 'INV-' || (o_custkey % 50) AS invoice_number, taxable_value, total_quantity,
    CASE WHEN o_orderkey % 2 = 0 THEN (tax_total * 0.5::DECIMAL(3,2))::DECIMAL(18,2) END AS cgst_amount, CASE WHEN o_orderkey % 2 = 0 THEN (tax_total * 0.5::DECIMAL(3,2))::DECIMAL(18,2) END AS sgst_amount,
    CASE WHEN o_orderkey % 2 = 1 THEN tax_total END AS igst_amount, o_totalprice::DECIMAL(18,2) AS grand_total,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice::DECIMAL(18,2) ELSE 0::DECIMAL(18,2) END AS amount_paid,
    CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 100)::DOUBLE / 100 END AS confidence, CASE WHEN o_orderkey % 7 = 0 THEN 'broker' ELSE '' END AS broker_name_raw, o_orderkey % 4 = 0 AS needs_review
  FROM dated LEFT JOIN sums ON o_orderkey = invoice_id
),
counted AS (SELECT * FROM invoices WHERE status IN ('extracted', 'needs_review', 'confirmed')),
parties AS (
  SELECT party_id, legal_name, n_name AS city, lpad(nk::VARCHAR, 2, '0') AS state_code, role FROM (
    SELECT s_suppkey AS party_id, s_name AS legal_name, s_nationkey AS nk, 'seller' AS role FROM supplier UNION ALL
    SELECT 1000000 + c_custkey, c_name, c_nationkey, 'buyer' FROM customer UNION ALL
    SELECT 2000000 + i, 'Broker ' || i, NULL, 'broker' FROM range(1, 9) r(i) UNION ALL
    SELECT 3000000 + i, 'Transporter ' || i, NULL, 'transporter' FROM range(1, 11) r(i)) LEFT JOIN nation ON n_nationkey = nk
),
products AS (SELECT p_partkey AS product_id, p_name AS name, p_type AS category, lpad(p_size::VARCHAR, 4, '0') AS hsn FROM part)
"""
