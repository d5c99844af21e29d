"""More named queries: parties and goods resolved, readings compared, whole bills, exports, lists, dictated deals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import printed as P
from ..operators import accrual, assembly, comparing, exports, labels, lifecycle, matching, reports, resolving, rules, sentences, spoken
from ..sources import bridge
from ..streaming import jobs
from .catalogue import ORACLES, B, Ledger, of_part, register, scratch

DIGITS36 = C.DIGITS36

# --- Parties ----------------------------------------------------------------------------------------------------------

#: Firms with names of their own; some pairs share a name, in two states or in one. %s is a name of two words.
FIRMS = """n AS (SELECT c_custkey AS id, c_custkey // 2 AS k, md5(CASE WHEN c_custkey // 2 % 5 < 2 THEN 'k' || (c_custkey // 2) ELSE 'c' || c_custkey END) AS h FROM customer),
firms AS (SELECT id, k, 'q' || h[1:7] || ' x' || h[9:15] AS stem, CASE WHEN k % 5 = 1 OR id % 2 = 0 THEN '27' ELSE '29' END AS state_code, CASE WHEN id % 3 = 0 THEN '27ABCDE' || lpad((id % 10000)::VARCHAR, 4, '0') || 'F1ZX' END AS gstin FROM n)"""


def firms(s: SparkSession, d: str) -> DataFrame:
    k = F.floor(F.col("c_custkey") / 2)
    h = F.md5(F.when(k % 5 < 2, F.concat(F.lit("k"), k.cast("string"))).otherwise(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    stem = F.concat(F.lit("q"), F.substring(h, 1, 7), F.lit(" x"), F.substring(h, 9, 7))
    return Ledger(s, d).customer.select(F.col("c_custkey").alias("id"), stem.alias("stem"), F.when((k % 5 == 1) | (F.col("c_custkey") % 2 == 0), "27").otherwise("29").alias("state_code"), F.expr("IF(c_custkey % 3 = 0, concat('27ABCDE', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'F1ZX'), NULL)").alias("gstin"))


def known_firms(s: SparkSession, d: str) -> DataFrame:
    return firms(s, d).select(F.col("id").alias("party_id"), F.concat("stem", F.lit(" Pvt Ltd")).alias("legal_name"), F.lit("").alias("display_name"), "state_code", "gstin")


#: Names as bills print them, by id % 8: another legal form (no state, own state), a number alone, none, misspelled, misspelled with
#: another number, a legal form alone, and a name that only the alias knows.
ASKED = "CASE id % 8 WHEN 0 THEN concat(stem, ' Private Limited') WHEN 1 THEN concat(stem, ' PVT. LTD') WHEN 2 THEN 'nobody' WHEN 3 THEN NULL WHEN 4 THEN concat(stem, 'k Pvt Ltd') WHEN 5 THEN concat(stem, 'k Pvt Ltd') WHEN 6 THEN 'The Trading Company' ELSE concat('zz', CAST(id AS STRING), ' kirana') END"
ASKED_NUMBER = "CASE id % 8 WHEN 2 THEN lower(gstin) WHEN 5 THEN '29ZZZZZ9999Z1Z9' END"
ASKED_STATE = "CASE WHEN id % 8 = 1 OR id % 8 >= 4 THEN state_code END"


def asked_firms(s: SparkSession, d: str) -> DataFrame:
    return firms(s, d).selectExpr("id AS ask_id", f"{ASKED} AS name", f"{ASKED_NUMBER} AS gstin", f"{ASKED_STATE} AS state_code")


def firm_aliases(s: SparkSession, d: str) -> DataFrame:
    return firms(s, d).where("id % 16 = 7").selectExpr("concat('ZZ', CAST(id AS STRING), ' Kirana Traders') AS alias", "id AS party_id")


FOUND = f"""WITH {FIRMS}, c AS (SELECT *, count(*) OVER (PARTITION BY stem) AS same, count(*) OVER (PARTITION BY stem, state_code) AS here, min(id) OVER (PARTITION BY stem) AS first, min(id) OVER (PARTITION BY stem, state_code) AS first_here FROM firms),
found AS (SELECT id AS ask_id, CASE id % 8 WHEN 0 THEN first WHEN 1 THEN CASE WHEN here = 1 THEN id ELSE first_here END WHEN 2 THEN CASE WHEN gstin IS NOT NULL THEN (SELECT min(o.id) FROM firms o WHERE o.gstin = c.gstin) END WHEN 4 THEN first_here
    WHEN 5 THEN CASE WHEN (SELECT gstin FROM firms o WHERE o.id = first_here) IS NULL THEN first_here END WHEN 7 THEN CASE WHEN id % 16 = 7 THEN id END END AS party_id,
  CASE id % 8 WHEN 0 THEN CASE WHEN same = 1 THEN 'by_name' ELSE 'by_fuzzy' END WHEN 1 THEN CASE WHEN same = 1 THEN 'by_name' WHEN here = 1 THEN 'by_state' ELSE 'by_fuzzy' END WHEN 2 THEN 'by_gstin' WHEN 4 THEN 'by_fuzzy' WHEN 5 THEN 'by_fuzzy' WHEN 7 THEN 'by_alias' END AS tier FROM c)
"""
register("find_parties", FOUND + "SELECT ask_id, party_id, CASE WHEN party_id IS NOT NULL THEN tier END AS tier FROM found")(
    lambda s, d: resolving.found_parties(asked_firms(s, d), known_firms(s, d), firm_aliases(s, d)))


def batch(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every firm on a bill under its own name with something new, and a new firm twice, once with its number."""
    f = firms(s, d)
    own = f.selectExpr("id AS ask_id", "IF(id % 2 = 0, 'seller', 'buyer') AS role", "concat(stem, IF(id % 4 = 0, ' Traders', ' Pvt Ltd')) AS name", "gstin", "state_code", "concat('Lane ', CAST(id AS STRING)) AS address").where("ask_id % 5 = 4")
    new = f.where("id % 5 = 0").selectExpr("id + 1000000 AS ask_id", "IF(id % 2 = 0, 'broker', 'transporter') AS role", "concat('Newco', CAST(id % 50 AS STRING), 'y Agro') AS name", "IF(id % 20 = 0, '07NEWCO0000N1ZN', NULL) AS gstin", "'27' AS state_code", "CAST(NULL AS STRING) AS address")
    return resolving.resolved_parties(own.unionByName(new), known_firms(s, d), firm_aliases(s, d).limit(0), tiers_only)


def tiers_only(asked: DataFrame, parties: DataFrame, aliases: DataFrame) -> DataFrame:
    return matching.exact_tiers(asked, parties, aliases)


BATCH = f"""WITH {FIRMS}, c AS (SELECT *, count(*) OVER (PARTITION BY stem) AS same, count(*) OVER (PARTITION BY stem, state_code) AS here, CASE WHEN gstin IS NOT NULL THEN min(id) OVER (PARTITION BY gstin) END AS by_number FROM firms),
own AS (SELECT id AS ask_id, CASE WHEN id % 2 = 0 THEN 'seller' ELSE 'buyer' END AS role, coalesce(by_number, CASE WHEN same = 1 OR here = 1 THEN id END) AS party_id, stem, state_code, 'Lane ' || id AS address, id % 4 = 0 AS other, gstin FROM c WHERE id % 5 = 4),
new AS (SELECT id + 1000000 AS ask_id, CASE WHEN id % 2 = 0 THEN 'broker' ELSE 'transporter' END AS role, CASE WHEN id % 20 = 0 THEN 'g' ELSE 'n' || id % 50 END AS who FROM firms WHERE id % 5 = 0),
links AS (SELECT ask_id, role, coalesce(party_id, -min(ask_id) OVER (PARTITION BY CASE WHEN party_id IS NULL THEN stem || state_code END)) AS party_id, CASE WHEN party_id IS NULL THEN 'created' WHEN gstin IS NOT NULL THEN 'by_gstin' WHEN (SELECT same FROM c WHERE id = ask_id) = 1 THEN 'by_name' ELSE 'by_state' END AS how FROM own
  UNION ALL SELECT ask_id, role, -min(ask_id) OVER (PARTITION BY who), 'created' FROM new)
"""
register("resolved_party_links", BATCH + "SELECT * FROM links")(lambda s, d: batch(s, d)["links"])
register("resolved_parties", BATCH + """SELECT party_id, bool_or(role = 'seller') AS is_seller, bool_or(role = 'buyer') AS is_buyer, bool_or(role = 'broker') AS is_broker, bool_or(role = 'transporter') AS is_transporter, arg_min(address, l.ask_id) FILTER (address IS NOT NULL) AS address
FROM links l LEFT JOIN own USING (ask_id, role) GROUP BY 1""".replace("LEFT JOIN own USING (ask_id, role)", "LEFT JOIN (SELECT ask_id, address FROM own) USING (ask_id)").replace("SELECT party_id,", "SELECT l.party_id AS party_id,"))(
    lambda s, d: batch(s, d)["parties"].where("is_seller OR is_buyer OR is_broker OR is_transporter").select("party_id", "is_seller", "is_buyer", "is_broker", "is_transporter", "address"))

PAIRS = "SELECT s_suppkey AS keep, s_suppkey + 1 AS drop FROM supplier WHERE s_suppkey % 4 = 1"


def merger(s: SparkSession, d: str) -> dict[str, DataFrame]:
    v = Ledger(s, d)
    sellers = v.supplier.selectExpr("s_suppkey AS party_id", "s_name AS legal_name", "CASE s_suppkey % 12 WHEN 1 THEN '27A' WHEN 2 THEN '27A' WHEN 5 THEN '27A' WHEN 6 THEN '27B' WHEN 10 THEN '27C' END AS gstin", "s_suppkey % 3 = 0 AS is_broker")
    aliases = v.supplier.selectExpr("s_suppkey AS party_id", "IF(s_suppkey % 2 = 0, 'Old Mill', s_name) AS alias")
    pairs = v.supplier.where("s_suppkey % 4 = 1").selectExpr("s_suppkey AS keep", "s_suppkey + 1 AS drop")
    return resolving.merged(v.invoices.select("id", "seller_id", "buyer_id"), sellers, aliases, pairs, ("seller", "buyer", "broker") if False else ("seller", "buyer"))


REFUSED = "s_suppkey % 12 = 5"  # of the pairs, those with two numbers
register("merge_parties", B + f", p AS (SELECT s_suppkey AS keep, s_suppkey + 1 AS drop FROM supplier WHERE s_suppkey % 4 = 1 AND NOT {REFUSED} AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)) SELECT id, coalesce(keep, seller_id) AS seller_id, buyer_id FROM invoices LEFT JOIN p ON seller_id = drop")(lambda s, d: merger(s, d)["facts"])
register("merge_parties_kept", f"WITH p AS (SELECT s_suppkey AS keep, s_suppkey + 1 AS drop FROM supplier WHERE s_suppkey % 4 = 1 AND NOT {REFUSED} AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)) SELECT s_suppkey AS party_id, CASE s_suppkey % 12 WHEN 1 THEN '27A' WHEN 2 THEN '27A' WHEN 5 THEN '27A' WHEN 6 THEN '27B' WHEN 10 THEN '27C' WHEN 9 THEN CASE WHEN p.keep IS NOT NULL THEN '27C' END END AS gstin FROM supplier LEFT JOIN p ON keep = s_suppkey WHERE s_suppkey NOT IN (SELECT drop FROM p)")(
    lambda s, d: merger(s, d)["parties"].select("party_id", "gstin"))
register("merge_parties_refused", f"SELECT s_suppkey AS keep, s_suppkey + 1 AS drop FROM supplier WHERE {REFUSED} AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)")(lambda s, d: merger(s, d)["refused"])
register("merge_parties_aliases", f"WITH p AS (SELECT s_suppkey AS keep, s_suppkey + 1 AS drop FROM supplier WHERE s_suppkey % 4 = 1 AND NOT {REFUSED} AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)) SELECT coalesce(keep, s_suppkey) AS party_id, 'Old Mill' AS alias FROM supplier LEFT JOIN p ON drop = s_suppkey WHERE s_suppkey % 2 = 0 UNION SELECT keep, s_name FROM p JOIN supplier ON drop = s_suppkey")(lambda s, d: merger(s, d)["aliases"])

# --- Goods ------------------------------------------------------------------------------------------------------------

GOODS = "('m' || md5(p_partkey::VARCHAR)[1:6] || ' n' || md5(p_partkey::VARCHAR)[8:13] || ' o' || md5(p_partkey::VARCHAR)[15:20])"


def goods(s: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("p_partkey").cast("string"))
    name = F.concat(F.lit("m"), F.substring(h, 1, 6), F.lit(" n"), F.substring(h, 8, 6), F.lit(" o"), F.substring(h, 15, 6))
    return Ledger(s, d).part.select(F.col("p_partkey").alias("product_id"), name.alias("name"), F.concat(F.lit("080"), (F.col("p_size") % 10).cast("string")).alias("hsn"), F.when(F.col("p_partkey") % 2 == 0, "W240").alias("grade"))


def asked_goods(s: SparkSession, d: str) -> DataFrame:
    """By id % 6: as it is, in capitals or not, a word more (same code and grade), a word more of another grade, a word
    more without a code, and an alias."""
    return goods(s, d).selectExpr("product_id AS ask_id", "CASE product_id % 6 WHEN 0 THEN upper(name) WHEN 1 THEN name WHEN 5 THEN concat('a', CAST(product_id AS STRING), 'z') ELSE concat(name, ' new') END AS description", "CASE WHEN product_id % 6 = 3 THEN 'other' ELSE CASE WHEN product_id % 6 > 1 THEN grade END END AS remarks", "IF(product_id % 6 = 4, NULL, hsn) AS hsn", "'kilo' AS uom")


def goods_aliases(s: SparkSession, d: str) -> DataFrame:
    return goods(s, d).where("product_id % 6 = 5").selectExpr("concat('A', CAST(product_id AS STRING), 'Z', IF(grade IS NULL, '', concat(' ', grade))) AS alias", "product_id")


register("find_products", f"""WITH g AS (SELECT p_partkey AS id, {GOODS} AS name FROM part)
SELECT id AS ask_id, CASE WHEN id % 6 IN (3, 4) THEN NULL ELSE id END AS product_id, CASE id % 6 WHEN 0 THEN 'by_name' WHEN 1 THEN 'by_name' WHEN 2 THEN 'by_fuzzy' WHEN 5 THEN 'by_alias' END AS tier FROM g""")(
    lambda s, d: resolving.found_products(asked_goods(s, d), goods(s, d), goods_aliases(s, d)).select("ask_id", "product_id", "tier"))
register("resolved_products", f"""WITH g AS (SELECT p_partkey AS id, {GOODS} AS name, p_size FROM part)
SELECT id AS ask_id, CASE WHEN id % 6 IN (3, 4) THEN -id ELSE id END AS product_id, CASE id % 6 WHEN 0 THEN 'by_name' WHEN 1 THEN 'by_name' WHEN 2 THEN 'by_fuzzy' WHEN 5 THEN 'by_alias' ELSE 'created' END AS how,
  CASE WHEN id % 6 IN (3, 4) THEN name || ' new' || CASE WHEN id % 6 = 3 THEN ' other' ELSE ' W240' END ELSE name END AS name, CASE WHEN id % 6 = 3 THEN CASE WHEN p_size % 10 = 2 THEN 'Nuts' ELSE 'Dry Fruits' END END AS category, 'KGS' AS uom FROM g""")(
    lambda s, d: resolving.resolved_products(asked_goods(s, d), goods(s, d), goods_aliases(s, d)).drop("hsn"))
register("product_labels", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_brand ELSE p_name || ' - ' || p_brand END AS label FROM part")(
    lambda s, d: of_part(s, d, label=C.product_label(F.expr("IF(p_partkey % 3 = 2, concat(p_name, ' - ', p_brand), p_name)"), F.expr("IF(p_partkey % 3 = 0, NULL, p_brand)"))))

# --- Cleaners ---------------------------------------------------------------------------------------------------------

SHAPES = ["'Dated ' || strftime(o_orderdate, '%d-%b-%y')", "strftime(o_orderdate, '%-d %B %Y')", "strftime(o_orderdate, '%B %-d, %Y')", "strftime(o_orderdate, '%d-%m-%y')", "strftime(o_orderdate, '%m/%d/%Y')", "strftime(o_orderdate, '%-dth of %b, %Y')"]
register("printed_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 = 4 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate::DATE END AS clean FROM orders")(
    lambda s, d: Ledger(s, d).orders.select(F.col("o_orderkey").alias("id"), C.date(F.expr("CASE o_orderkey % 7 WHEN 0 THEN concat('Dated ', date_format(o_orderdate, 'dd-MMM-yy')) WHEN 1 THEN date_format(o_orderdate, 'd MMMM yyyy') WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'dd-MM-yy') WHEN 4 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 5 THEN date_format(o_orderdate, \"d'th of' MMM, yyyy\") ELSE 'no date 31/02/1995' END")).alias("clean")))
TENS = ("Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety")
register("words_amounts", f"""SELECT p_partkey AS id, (v * 1000 + u + CASE p_partkey % 3 WHEN 0 THEN 0 ELSE w / 100 END)::DOUBLE AS amount FROM (SELECT p_partkey, (p_partkey % 8 + 2) * 10 AS v, (p_size % 8 + 2) * 10 AS w, (p_partkey // 8 % 8 + 2) * 10 AS u FROM part)""")(
    lambda s, d: lifecycle.spread(Ledger(s, d).part.select("p_partkey", "p_size")).select(F.col("p_partkey").alias("id"), C.words_amount(F.expr("concat('Amount Chargeable (in words): INR ', {0}, ' Thousand ', {1}, CASE p_partkey % 3 WHEN 0 THEN ' Only' WHEN 1 THEN concat(' and ', {2}, ' paise Only') ELSE concat(' Rupees and ', {2}, ' only') END)".format(*(f"element_at(array{TENS}, CAST({x} % 8 + 1 AS INT))" for x in ("p_partkey", "floor(p_partkey / 8)", "p_size"))))).cast("double").alias("amount")))
register("percents", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size / 100.0 WHEN 1 THEN p_size + 0.5 END::DOUBLE AS rate FROM part")(
    lambda s, d: of_part(s, d, rate=C.percent(F.expr("CASE p_partkey % 3 WHEN 0 THEN CAST(CAST(p_size / 100 AS DECIMAL(6,2)) AS STRING) WHEN 1 THEN concat(p_size, '.5 %') ELSE '%' END")).cast("double")))
register("pan_texts", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN upper(regexp_replace(p_brand || p_partkey, '[^0-9A-Za-z]', '', 'g')) END AS pan FROM part")(
    lambda s, d: of_part(s, d, pan=C.alnum_upper(F.expr("IF(p_partkey % 4 = 0, ' -. ', concat(lower(p_brand), ' - ', p_partkey))"))))
register("plain_scripts", "SELECT p_partkey AS id, p_partkey || ' ' || p_size || ' cafe kela फल' AS text FROM part")(
    lambda s, d: of_part(s, d, text=C.plain_script(F.concat(F.translate(F.col("p_partkey").cast("string"), "0123456789", "०१२३४५६७८९"), F.lit(" "), F.translate(F.col("p_size").cast("string"), "0123456789", "૦૧૨૩૪૫૬૭૮૯"), F.lit(" café kéla फ़ल")))))
NUMBER = f"concat(lpad(CAST(p_partkey % 40 AS STRING), 2, '0'), ' abcde-', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), 'F', p_partkey % 9 + 1, IF(p_partkey % 11 = 0, 'Y', 'z'), IF(p_partkey % 7 = 0, '', substr('{DIGITS36}', CAST(p_partkey % 36 + 1 AS INT), 1)))"
register("gstin_problems", f"""WITH g AS (SELECT p_partkey AS id, lpad((p_partkey % 40)::VARCHAR, 2, '0') || 'ABCDE' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || 'F' || (p_partkey % 9 + 1) || CASE WHEN p_partkey % 11 = 0 THEN 'Y' ELSE 'Z' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '{DIGITS36}'[p_partkey % 36 + 1] END AS g FROM part),
w AS (SELECT *, list_sum([(strpos('{DIGITS36}', g[i]) - 1) * (2 - i % 2) // 36 + (strpos('{DIGITS36}', g[i]) - 1) * (2 - i % 2) % 36 for i in range(1, 15)]) AS t FROM g)
SELECT id, CASE WHEN length(g) <> 15 THEN 'length' ELSE concat_ws(',', CASE WHEN g[14] <> 'Z' THEN 'pattern' END, CASE WHEN g[1:2]::INT NOT BETWEEN 1 AND 38 OR g[1:2] = '28' THEN 'state' END, CASE WHEN '{DIGITS36}'[((36 - t % 36) % 36 + 1)::INT] <> g[15] THEN 'checksum' END) END AS problems FROM w""")(
    lambda s, d: of_part(s, d, problems=F.array_join(C.gstin_problems(C.alnum_upper(F.expr(NUMBER))), ",")))
register("party_names", "SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') || ' sons b 12' AS name_key, regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') || ' impex private limited and sons b 12' AS name_light FROM customer")(
    lambda s, d: Ledger(s, d).customer.select(F.col("c_custkey").alias("id"), C.name_key(F.concat("c_name", F.lit(" Impex Pvt. LTD & sons B-12"))).alias("name_key"), C.name_light(F.concat("c_name", F.lit(" Impex Pvt. LTD & sons B-12"))).alias("name_light")))

# --- Readings ---------------------------------------------------------------------------------------------------------


def reading(s: SparkSession, d: str, second: bool) -> DataFrame:
    """Bills as nested readings; the second one has other values here and there, and writes the same ones otherwise."""
    v = Ledger(s, d)
    lines = v.lines.select("invoice_id", F.struct("line_no", F.col("taxable_amount"), F.expr("quantity + IF({0} AND invoice_id % 6 = 1 AND line_no = 2, 1, 0)".format(str(second).lower())).alias("quantity"), F.expr("CAST(NULL AS DECIMAL(18,4))").alias("rate"), F.expr("concat(IF({0}, ' Part ', 'part '), product_id)".format(str(second).lower())).alias("description")).alias("l"))
    rows = lines.where("NOT (invoice_id % 10 = 3 AND l.line_no = 1)") if second else lines
    nested = rows.groupBy("invoice_id").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    x = "{0}".format(str(second).lower())
    heads = v.invoices.selectExpr("id", f"IF({x}, concat(' ', lower(invoice_number)), invoice_number) AS invoice_number", f"IF({x} AND id % 8 = 0, date_add(invoice_date, 1), invoice_date) AS invoice_date", "named_struct('name', concat('S', seller_id), 'gstin', CAST(NULL AS STRING)) AS seller", f"named_struct('name', 'B', 'gstin', IF({x}, '27-abc', '27ABC')) AS buyer", f"IF({x} AND id % 9 = 0, 'broker x', broker_name_raw) AS broker_name", "taxable_value", f"IF({x} AND id % 12 = 0, grand_total + 0.01, grand_total) AS grand_total", "total_quantity")
    return heads.join(nested, heads["id"] == nested["invoice_id"], "left").drop("invoice_id")


DIFFER = B + """, d AS (SELECT id, 'invoice_date' AS field_path, invoice_date::VARCHAR AS first, (invoice_date + 1)::VARCHAR AS second FROM invoices WHERE id % 8 = 0
UNION ALL SELECT id, 'broker_name', nullif(broker_name_raw, ''), 'broker x' FROM invoices WHERE id % 9 = 0
UNION ALL SELECT id, 'grand_total', grand_total::VARCHAR, (grand_total + 0.01)::DECIMAL(18,2)::VARCHAR FROM invoices WHERE id % 12 = 0
UNION ALL SELECT invoice_id, 'lines', count(*)::VARCHAR, (count(*) - 1)::VARCHAR FROM lines WHERE invoice_id % 10 = 3 GROUP BY 1
UNION ALL SELECT invoice_id, 'lines.2.quantity', quantity::DECIMAL(18,2)::VARCHAR, (quantity + 1)::DECIMAL(18,2)::VARCHAR FROM lines WHERE line_no = 2 AND invoice_id % 6 = 1 AND invoice_id % 10 <> 3) """
register("readings_compared", DIFFER + "SELECT * FROM d")(lambda s, d: comparing.readings_differ(reading(s, d, False), reading(s, d, True)))
register("flags_readings", DIFFER + "SELECT id AS invoice_id, 'readings_disagree' AS rule, 'error' AS severity, field_path, first AS expected, second AS actual FROM d")(
    lambda s, d: comparing.disagreements(comparing.readings_differ(reading(s, d, False), reading(s, d, True))))
register("second_reading_needed", B + "SELECT id, CASE WHEN id % 31 = 0 OR grand_total >= 1000000 OR coalesce(confidence, 0) < 0.9 THEN 'large' END AS model FROM invoices")(
    lambda s, d: Ledger(s, d).invoices.select("id", comparing.second_reading(F.expr("IF(id % 31 = 0, IF(id % 2 = 0, 'ocr_vision', NULL), 'text_layer')"), F.col("grand_total"), F.col("confidence"), "large", "small").alias("model")))
register("reading_agreement", B + "SELECT field, checked, count(*) FILTER (ok) AS hits, count(*) AS total FROM (SELECT 'grand_total' AS field, true AS checked, id % 12 <> 0 AS ok FROM invoices UNION ALL SELECT 'invoice_number', false, true FROM invoices UNION ALL SELECT 'invoice_date', false, id % 8 <> 0 FROM invoices) GROUP BY ALL")(
    lambda s, d: comparing.agreement(reading(s, d, False), reading(s, d, True), {"grand_total": "money", "invoice_number": "text", "invoice_date": "date"}, {"grand_total"}))

# --- Exports and lists ------------------------------------------------------------------------------------------------


def full_bills(s: SparkSession, d: str) -> DataFrame:
    return Ledger(s, d).invoices.selectExpr("*", "seller_id + 0 AS consignee_id", "'tax_invoice' AS document_type", "concat('MH', id) AS vehicle_no", "CAST(NULL AS STRING) AS eway_bill_no", "IF(id % 2 = 0, 'intra', 'inter') AS supply_type", "'KGS' AS total_quantity_uom", "CAST(id % 7 AS DECIMAL(18,3)) AS total_bags", "taxable_value AS subtotal", "concat('bill-', id, '.pdf') AS source_file")


def numbered_parties(s: SparkSession, d: str) -> DataFrame:
    return Ledger(s, d).parties.withColumn("gstin", F.concat(F.lit("G"), F.col("party_id").cast("string")))


BILL_EXPORT = """SELECT i.id AS invoice_id, invoice_number, invoice_date, financial_year, 'tax_invoice' AS document_type, a.legal_name AS seller, 'G' || seller_id AS seller_gstin, b.legal_name AS buyer, CASE WHEN b.party_id IS NOT NULL THEN 'G' || buyer_id END AS buyer_gstin, a.legal_name AS consignee,
  CASE WHEN broker_id IS NULL THEN broker_name_raw ELSE k.legal_name END AS broker, t.legal_name AS transporter, 'MH' || i.id AS vehicle_no, NULL::VARCHAR AS eway_bill_no, NULL::VARCHAR AS place_of_supply, CASE WHEN i.id % 2 = 0 THEN 'intra' ELSE 'inter' END AS supply_type, NULL::VARCHAR AS payment_terms, NULL::VARCHAR AS due_date,
  total_quantity::DOUBLE AS total_quantity, 'KGS' AS uom, (i.id % 7)::DOUBLE AS total_bags, taxable_value::DOUBLE AS subtotal, NULL::VARCHAR AS discount_total, taxable_value::DOUBLE AS taxable_value, cgst_amount::DOUBLE AS cgst, sgst_amount::DOUBLE AS sgst, igst_amount::DOUBLE AS igst, NULL::VARCHAR AS cess, NULL::VARCHAR AS tcs, NULL::VARCHAR AS other_charges, NULL::VARCHAR AS round_off,
  grand_total::DOUBLE AS grand_total, amount_paid::DOUBLE AS amount_paid, CASE WHEN amount_paid <= 0 THEN 'unpaid' WHEN amount_paid >= grand_total THEN 'paid' ELSE 'partial' END AS payment_status, status, confidence, NULL::VARCHAR AS irn, 'bill-' || i.id || '.pdf' AS source_file
FROM {of} i LEFT JOIN parties a ON a.party_id = seller_id LEFT JOIN parties b ON b.party_id = buyer_id LEFT JOIN parties t ON t.party_id = transporter_id LEFT JOIN parties k ON k.party_id = broker_id"""
register("export_invoices", B + BILL_EXPORT.replace("{of}", "counted"))(lambda s, d: exports.invoices(full_bills(s, d), numbered_parties(s, d)))
register("export_rejected", B + BILL_EXPORT.replace("{of}", "invoices") + " WHERE status = 'rejected' AND seller_id = 3 AND financial_year = '1995-96'")(lambda s, d: exports.invoices(full_bills(s, d), numbered_parties(s, d), status="rejected", seller_id=3, fy="1995-96"))
LINE_EXPORT = """SELECT i.id AS invoice_id, invoice_number, invoice_date, a.legal_name AS seller, b.legal_name AS buyer, line_no, 'part ' || product_id AS description, NULL::VARCHAR AS item_code, 'W' || line_no AS grade, NULL::VARCHAR AS brand, p.name AS product, p.hsn AS hsn, NULL::VARCHAR AS bags, quantity::DOUBLE AS quantity, 'KGS' AS uom, NULL::VARCHAR AS rate, NULL::VARCHAR AS discount_pct, l.taxable_amount::DOUBLE AS taxable_amount, NULL::VARCHAR AS tax_rate, NULL::VARCHAR AS cgst, NULL::VARCHAR AS sgst, tax_amount::DOUBLE AS igst
FROM counted i JOIN lines l ON i.id = l.invoice_id LEFT JOIN products p USING (product_id) LEFT JOIN parties a ON a.party_id = seller_id LEFT JOIN parties b ON b.party_id = buyer_id"""


def full_lines(s: SparkSession, d: str) -> DataFrame:
    v = Ledger(s, d)
    return v.lines.join(v.products.select("product_id", "hsn"), "product_id", "left").selectExpr("*", "concat('part ', product_id) AS description", "concat('W', line_no) AS item_remarks", "'KGS' AS uom", "tax_amount AS igst_amount")


register("export_lines", B + LINE_EXPORT)(lambda s, d: exports.lines(full_lines(s, d), Ledger(s, d).invoices, Ledger(s, d).parties, Ledger(s, d).products))


def export_csv(s: SparkSession, d: str) -> DataFrame:
    """The export of bills as CSV files, and what they say."""
    path = f"{scratch(s)}/csv-{uuid.uuid4()}"
    exports.write_csv(exports.invoices(full_bills(s, d), numbered_parties(s, d)).drop("confidence"), path)
    return s.read.option("header", True).csv(path).select("invoice_id", "seller", "invoice_date", "payment_status", "source_file", "broker")


register("export_csv", B + f"SELECT invoice_id::VARCHAR AS invoice_id, seller, invoice_date::VARCHAR AS invoice_date, payment_status, source_file, nullif(broker, '') AS broker FROM ({BILL_EXPORT.replace('{of}', 'counted')})")(export_csv)


def export_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Documents as JSON lines, training and test parts apart, and what the files say."""
    path, docs = f"{scratch(s)}/jsonl-{uuid.uuid4()}", Ledger(s, d).documents.where("lang = 'en' AND text IS NOT NULL").select("doc_id", "lang", "n_chars")
    exports.write_jsonl(docs.join(reports.holdout(docs, "doc_id"), "doc_id"), path)
    return s.read.schema("doc_id long, lang string, n_chars long, part string").json(path)


register("export_jsonl", "SELECT doc_id, lang, n_chars, CASE WHEN row_number() OVER (ORDER BY doc_id) <= greatest(1, floor(count(*) OVER () * 0.85)) THEN 'train' ELSE 'test' END AS part FROM documents WHERE lang = 'en' AND text IS NOT NULL")(export_jsonl)
STATUS = "CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'processed' ELSE 'queued' END"
docs_of = lambda s, d: Ledger(s, d).documents.selectExpr("doc_id AS id", f"{STATUS} AS status", "timestamp_seconds(doc_id % 40) AS created_at")
register("document_list", f"SELECT doc_id AS id FROM documents WHERE {STATUS} = 'processed' ORDER BY doc_id % 40 DESC, doc_id DESC LIMIT 30 OFFSET 10")(lambda s, d: exports.document_list(docs_of(s, d), "processed", 30, 10).select("id"))
register("failed_documents", f"SELECT doc_id AS id FROM documents WHERE {STATUS} = 'failed' ORDER BY doc_id % 40 DESC, doc_id DESC LIMIT 200")(lambda s, d: reports.failed_documents(docs_of(s, d)).select("id"))
register("clip_counts", "SELECT count(*) FILTER (event_type = 'click') AS pending, count(*) FILTER (event_type = 'purchase') AS confirmed, 0::BIGINT AS corrected FROM events")(
    lambda s, d: exports.clip_counts(Ledger(s, d).events.selectExpr("CASE event_type WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'confirmed' ELSE 'other' END AS status")))
register("newest_trades", "SELECT event_id AS id, value FROM events ORDER BY event_id DESC LIMIT 50")(lambda s, d: exports.newest(Ledger(s, d).events.select(F.col("event_id").alias("id"), "value")))
register("one_invoice", B + "SELECT id, status FROM invoices WHERE id = 7")(lambda s, d: exports.one(Ledger(s, d).invoices, 7).select("id", "status"))
register("invoice_page_total", B + "SELECT id, (SELECT count(*) FROM invoices WHERE status = 'confirmed') AS total FROM (SELECT id FROM invoices WHERE status = 'confirmed' ORDER BY id DESC LIMIT 20 OFFSET 40)")(
    lambda s, d: (lambda page, n: page.select("id", F.lit(n).cast("long").alias("total")))(*exports.paged(Ledger(s, d).invoices.where("status = 'confirmed'"), [F.desc("id")], 20, 40)))
register("party_display", B + "SELECT party_id, CASE WHEN party_id % 3 = 0 THEN 'M/s ' || party_id ELSE legal_name END AS name FROM parties")(
    lambda s, d: (lambda p: p.select("party_id", exports.shown(p).alias("name")))(Ledger(s, d).parties.withColumn("display_name", F.expr("CASE party_id % 3 WHEN 0 THEN concat('M/s ', party_id) WHEN 1 THEN '' END"))))
register("party_search_gstin", B + "SELECT party_id FROM parties WHERE role = 'buyer' AND (legal_name ILIKE '%G100001%' OR city ILIKE '%G100001%' OR 'G' || party_id ILIKE '%G100001%') ORDER BY legal_name, party_id LIMIT 50")(
    lambda s, d: reports.party_search(numbered_parties(s, d), "buyer", " g100001").select("party_id"))
register("search_invoices", B + """SELECT id, status FROM invoices WHERE invoice_number ILIKE '%00012%' OR financial_year ILIKE '%00012%' OR status ILIKE '%00012%' OR broker_name_raw ILIKE '%00012%'
OR seller_id IN (SELECT party_id FROM parties WHERE legal_name ILIKE '%00012%') OR buyer_id IN (SELECT party_id FROM parties WHERE legal_name ILIKE '%00012%')""")(lambda s, d: reports.search(Ledger(s, d).invoices, Ledger(s, d).parties, " 00012 ").select("id", "status"))
register("payment_statuses", B + "SELECT id, CASE WHEN coalesce(p, 0) <= 0 THEN 'unpaid' WHEN p >= grand_total THEN 'paid' ELSE 'partial' END AS payment_status FROM (SELECT id, grand_total, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 1 ELSE amount_paid END AS p FROM invoices)")(
    lambda s, d: Ledger(s, d).invoices.select("id", exports.payment_status(F.expr("CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 1 ELSE amount_paid END"), F.col("grand_total")).alias("payment_status")))

# --- Brokerage by code ------------------------------------------------------------------------------------------------

CODE_RULES = "(1, NULL, NULL, NULL, '', NULL, NULL, 'taxable_value', 1.5, NULL, NULL), (2, NULL, NULL, NULL, '0007', NULL, NULL, 'grand_total', 0.75, NULL, 'buyer'), (3, 3, NULL, NULL, '0012', NULL, NULL, 'taxable_value', 2.0, NULL, 'both'), (4, NULL, NULL, 5, '0020', NULL, NULL, 'taxable_value', 3.0, NULL, ''), (5, 3, NULL, NULL, NULL, DATE '1996-01-01', DATE '1997-12-31', 'subtotal', 0.5, NULL, NULL)"
CODE_COLUMNS = "rule_id, seller_id, buyer_id, product_id, hsn, effective_from, effective_to, basis, pct, rate_per_unit, payable_by"
BY_CODE = B + f""", r AS (SELECT * FROM (VALUES {CODE_RULES}) v({CODE_COLUMNS})),
sets AS (SELECT invoice_id, list(DISTINCT product_id) AS ps, list(DISTINCT hsn) AS hs FROM lines JOIN products USING (product_id) GROUP BY 1),
m AS (SELECT i.id, arg_min(rule_id, (-(4 * (r.seller_id IS NOT NULL)::INT + 2 * (r.product_id IS NOT NULL)::INT + (coalesce(r.hsn, '') <> '')::INT)) * 100 + rule_id) AS rule_id FROM invoices i LEFT JOIN sets ON invoice_id = i.id
  JOIN r ON (r.seller_id IS NULL OR r.seller_id = i.seller_id) AND (r.product_id IS NULL OR list_contains(ps, r.product_id)) AND (coalesce(r.hsn, '') = '' OR list_contains(hs, r.hsn)) AND (i.invoice_date IS NULL OR (coalesce(r.effective_from <= i.invoice_date, true) AND coalesce(r.effective_to >= i.invoice_date, true))) GROUP BY 1),
e AS (SELECT i.id AS invoice_id, rule_id, coalesce(nullif(CASE basis WHEN 'grand_total' THEN grand_total WHEN 'subtotal' THEN taxable_value ELSE taxable_value END, 0), nullif(taxable_value, 0), grand_total, 0)::DECIMAL(18,2) AS b, coalesce(pct, 1.0)::DECIMAL(9,4) AS pct, coalesce(nullif(payable_by, ''), 'seller') AS payable_by FROM invoices i LEFT JOIN m USING (id) LEFT JOIN r USING (rule_id))
"""


def coded_entries(s: SparkSession, d: str) -> DataFrame:
    v = Ledger(s, d)
    table = s.sql(f"SELECT rule_id, CAST(seller_id AS BIGINT) AS seller_id, CAST(buyer_id AS BIGINT) AS buyer_id, CAST(product_id AS BIGINT) AS product_id, CAST(hsn AS STRING) AS hsn, CAST(effective_from AS DATE) AS effective_from, CAST(effective_to AS DATE) AS effective_to, basis, CAST(pct AS DECIMAL(9,4)) AS pct, CAST(rate_per_unit AS DECIMAL(9,4)) AS rate_per_unit, CAST(payable_by AS STRING) AS payable_by FROM VALUES {CODE_RULES} AS t({CODE_COLUMNS})")
    lines = v.plain_lines.join(v.products.select("product_id", "hsn"), "product_id", "left")
    return accrual.accrued(v.invoices.withColumn("subtotal", F.col("taxable_value")), table, lines)


register("brokerage_by_code", BY_CODE + "SELECT invoice_id, rule_id::INTEGER AS rule_id, b::DOUBLE AS basis_amount, round_even((b * pct * 0.01::DECIMAL(3,2))::DECIMAL(34,8), 2)::DOUBLE AS amount, payable_by FROM e")(
    lambda s, d: coded_entries(s, d).select("invoice_id", F.col("rule_id").cast("int").alias("rule_id"), F.col("basis_amount").cast("double").alias("basis_amount"), F.col("amount").cast("double").alias("amount"), "payable_by"))

# --- A bill's life ----------------------------------------------------------------------------------------------------


def dated_edits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bills = Ledger(s, d).invoices.select("id", "invoice_number", "invoice_date", "financial_year", F.col("grand_total"))
    asked = bills.where("id % 5 = 0").selectExpr("id", "inline(array(named_struct('field', 'invoice_date', 'value', date_format(add_months(invoice_date, 12), 'd-MMM-yy')), named_struct('field', 'grand_total', 'value', concat('Rs ', grand_total + id % 2)), named_struct('field', 'invoice_number', 'value', concat(' ', invoice_number, ' ')), named_struct('field', 'financial_year', 'value', 'no')))")
    return lifecycle.edited(bills, asked, ["invoice_number", "invoice_date", "grand_total"], {"invoice_date": C.date, "grand_total": C.amount})


MOVED = "(invoice_date + INTERVAL 12 MONTH)::DATE"
register("edited_dates", B + f"SELECT id, invoice_number, CASE WHEN id % 5 = 0 THEN {MOVED} ELSE invoice_date END AS invoice_date, CASE WHEN id % 5 = 0 THEN (financial_year[1:4]::INT + 1) || '-' || lpad(((financial_year[1:4]::INT + 2) % 100)::VARCHAR, 2, '0') ELSE financial_year END AS financial_year, (grand_total + CASE WHEN id % 10 = 5 THEN 1 ELSE 0 END)::DOUBLE AS grand_total FROM invoices")(
    lambda s, d: dated_edits(s, d)[0].withColumn("grand_total", F.col("grand_total").cast("double")))
register("edited_dates_log", B + f"SELECT id, 'invoice_date' AS field, invoice_date::VARCHAR AS before, {MOVED}::VARCHAR AS after FROM invoices WHERE id % 5 = 0 UNION ALL SELECT id, 'grand_total', grand_total::VARCHAR, (grand_total + 1)::DECIMAL(18,2)::VARCHAR FROM invoices WHERE id % 10 = 5")(lambda s, d: dated_edits(s, d)[1])
register("document_statuses", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'confirmed' ELSE CASE doc_id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'extracted' WHEN 2 THEN 'failed' WHEN 3 THEN 'queued' ELSE 'needs_review' END END AS status FROM documents")(
    lambda s, d: Ledger(s, d).documents.select(F.col("doc_id").alias("id"), lifecycle.document_status(F.expr("IF(doc_id % 4 = 0, 'confirmed', 'queued')"), F.expr("element_at(array('start', 'read', 'error', 'retry', 'flagged'), CAST(doc_id % 5 + 1 AS INT))")).alias("status")))
register("job_outcomes", "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'done' WHEN event_type = 'click' AND user_id % 3 + 1 < 3 THEN 'queued' ELSE 'failed' END AS status, user_id % 3 + 1 AS attempts FROM events")(
    lambda s, d: jobs.outcomes(Ledger(s, d).events.selectExpr("event_id AS id", "user_id % 3 AS attempts", "IF(event_type = 'view', NULL, 'timeout') AS error", "event_type = 'click' AS retryable", "'running' AS status")).select("id", "status", "attempts"))
register("latest_readings", B + "SELECT id AS sha, CASE WHEN id % 3 = 0 AND status <> 'confirmed' THEN 'again' ELSE status END AS status FROM invoices")(
    lambda s, d: jobs.latest((v := Ledger(s, d).invoices.selectExpr("id AS sha", "status")), v.where("sha % 3 = 0").withColumn("status", F.lit("again")), "sha"))
register("carried_flags", B + "SELECT id AS invoice_id, 'low_confidence' AS rule, id % 2 = 0 AS resolved FROM invoices WHERE confidence < 0.85")(
    lambda s, d: (lambda f: rules.carried(f, f.withColumn("resolved", F.col("invoice_id") % 2 == 0)).select("invoice_id", "rule", "resolved"))(rules.confidence(Ledger(s, d).invoices)))


def stream_checks(s: SparkSession, d: str) -> DataFrame:
    """Bills streamed in, each looked for among all before it."""
    root = f"{scratch(s)}/checks-{uuid.uuid4()}"
    bills = Ledger(s, d).invoices.select("id", "seller_id", "invoice_number", "financial_year")
    bills.repartitionByRange(3, "id").write.parquet(f"{root}/in")
    stream = s.readStream.schema(bills.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.check_stream(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return s.read.parquet(f"{root}/out/checks").drop("batch")


def batch_checks(s: SparkSession, d: str) -> DataFrame:
    bills = Ledger(s, d).invoices.select("id", "seller_id", "invoice_number", "financial_year")
    return jobs.checked(bills.where("id % 4 = 3"), bills.where("id % 4 <> 3"))


register("arrivals_checked", B + """, n AS (SELECT id, seller_id, invoice_number, coalesce(financial_year, '') AS fy FROM invoices), o AS (SELECT * FROM n WHERE id % 4 <> 3),
f AS (SELECT seller_id, invoice_number, fy, min(id) AS first FROM o WHERE seller_id IS NOT NULL AND invoice_number <> '' GROUP BY ALL)
SELECT n.id, CASE WHEN n.seller_id IS NOT NULL THEN coalesce(f.first, nullif(min(n.id) OVER (PARTITION BY n.seller_id, n.invoice_number, n.fy), n.id)) END AS duplicate_of, n.seller_id IS NOT NULL AND n.seller_id NOT IN (SELECT seller_id FROM o WHERE seller_id IS NOT NULL) AND min(n.id) OVER (PARTITION BY n.seller_id) = n.id AS first_of_seller
FROM n LEFT JOIN f ON f.seller_id = n.seller_id AND f.invoice_number = n.invoice_number AND f.fy = n.fy WHERE n.id % 4 = 3""")(batch_checks)
register("stream_first_bills", B + "SELECT count(*) FILTER (f) AS firsts, count(*) AS bills FROM (SELECT seller_id IS NOT NULL AND row_number() OVER (PARTITION BY seller_id ORDER BY id) = 1 AS f FROM invoices)")(
    lambda s, d: stream_checks(s, d).agg(F.count_if("first_of_seller").alias("firsts"), F.count("*").alias("bills")))


def reread(s: SparkSession, d: str) -> dict[str, DataFrame]:
    v = Ledger(s, d)
    old = {"invoices": v.invoices.select("id", "grand_total"), "lines": v.lines.select("invoice_id", "line_no")}
    new = {"invoices": old["invoices"].where("id % 6 = 0").withColumn("remarks", F.lit("again")), "lines": old["lines"].where("invoice_id % 6 = 0 AND line_no = 1")}
    return jobs.persisted(old, new)


register("persisted_bills", B + "SELECT id, grand_total::DOUBLE AS grand_total, CASE WHEN id % 6 = 0 THEN 'again' END AS remarks FROM invoices")(lambda s, d: reread(s, d)["invoices"].withColumn("grand_total", F.col("grand_total").cast("double")))
register("persisted_lines", B + "SELECT invoice_id, line_no FROM lines WHERE invoice_id % 6 <> 0 OR line_no = 1")(lambda s, d: reread(s, d)["lines"])

# --- Whole bills ------------------------------------------------------------------------------------------------------


def printed_bills(s: SparkSession, d: str) -> DataFrame:
    """Bills put together from what could be read of orders: some values are printed, some only in the code."""
    v = Ledger(s, d)
    o = v.orders.selectExpr("o_orderkey AS bill", "o_custkey AS cust", "o_orderdate AS day", "CAST(o_totalprice AS DECIMAL(18,2)) AS total")
    pages = o.selectExpr(
        "bill", "IF(bill % 3 = 0, ' ', concat('INV-', bill)) AS invoice_number", "IF(bill % 4 = 0, 'none', date_format(day, 'd-MMM-yy')) AS invoice_date", "CAST(NULL AS STRING) AS irn", "IF(bill % 5 = 0, 'x(cid:3)', concat('Mill ', cust)) AS seller_name", "IF(bill % 2 = 0, NULL, concat('27S', cust)) AS seller_gstin", "'Buyer' AS buyer_name", "CAST(NULL AS STRING) AS buyer_gstin",
        "'Store' AS consignee_name", "IF(bill % 6 = 0, concat('27B', cust), concat('27C', cust)) AS consignee_gstin", "' Pune ' AS place_of_supply", "IF(bill % 2 = 0, '7 Days', '') AS payment_terms", "CAST(NULL AS STRING) AS broker_name", "CAST(NULL AS STRING) AS remarks", "IF(bill % 7 = 0, 'EWB 1234 5678 9012', NULL) AS eway_bill_no", "IF(bill % 7 = 1, '999', NULL) AS annexure_eway_no",
        "IF(bill % 8 = 0, total, NULL) AS taxable_value", "CAST(IF(bill % 9 = 0, 0, IF(bill % 9 = 1, 5, NULL)) AS DECIMAL(18,2)) AS igst_amount", "CAST(NULL AS DECIMAL(18,2)) AS cgst_amount", "CAST(NULL AS DECIMAL(18,2)) AS sgst_amount", "CAST(IF(bill % 10 = 0, 0.34, NULL) AS DECIMAL(18,2)) AS round_off", "IF(bill % 3 = 1, total + 50, total) AS grand_total", "IF(bill % 3 = 1, 'Rupees Seven Only', NULL) AS total_in_words")
    code = o.where("bill % 4 < 2").selectExpr("bill", "concat('QR', bill) AS code_number", "date_format(day, 'dd/MM/yyyy') AS code_date", "'irn' AS code_irn", "concat('27Q', cust) AS code_seller_gstin", "concat('27B', cust) AS code_buyer_gstin", "total AS code_total")
    rows = v.lines.selectExpr("invoice_id AS bill", "line_no AS row_no", "'goods' AS class", "CAST(NULL AS STRING) AS charge", "concat('part ', product_id) AS text", "taxable_amount AS amount", "IF(line_no = 1, '7', '') AS serial", "concat('part ', product_id) AS description", "CAST(NULL AS STRING) AS hsn", "concat(CAST(quantity AS STRING), IF(line_no = 2, ' kgs', '')) AS quantity", "'bag' AS rate_uom", "'12.5' AS rate", "IF(line_no = 1, '3', '') AS bags")
    other = lambda n, class_, charge, text, amount: o.selectExpr("bill", f"{n} AS row_no", f"'{class_}' AS class", f"{charge} AS charge", f"'{text}' AS text", f"CAST({amount} AS DECIMAL(18,2)) AS amount", "'' AS serial", "'' AS description", "CAST(NULL AS STRING) AS hsn", "'' AS quantity", "'' AS rate_uom", "'' AS rate", "'' AS bags")
    rows = rows.unionByName(other(90, "charge", "'freight'", "Freight  in", "IF(bill % 2 = 0, 100, NULL)")).unionByName(other(91, "charge", "'discount'", "Less discount", "20")).unionByName(other(92, "tax", "CAST(NULL AS STRING)", "Output I GST @ 5", "bill % 100")).unionByName(other(93, "total", "CAST(NULL AS STRING)", "Total", "1"))
    summary = o.where("bill % 11 = 0").selectExpr("bill", "array(named_struct('hsn', '0802', 'taxable_value', CAST(700 AS DECIMAL(18,2)))) AS summary", "CAST(700 AS DECIMAL(18,2)) AS summary_taxable")
    bank = assembly.bank_details(o.selectExpr("bill", "IF(bill % 2 = 0, 'pay to HDFC0001234 now', 'pay') AS text", "CAST(NULL AS STRING) AS bank_name", "IF(bill % 3 = 0, 'A/c 12-34', NULL) AS account", "IF(bill % 2 = 0, ' Fort & HDFC0001234', NULL) AS branch"))
    return assembly.assembled(pages, assembly.table_parts(rows), summary, code, bank)


BILLS = B + """, o AS (SELECT o_orderkey AS bill, o_custkey AS cust, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS total, o_orderkey % 4 < 2 AS coded FROM orders),
g AS (SELECT invoice_id AS bill, count(*) AS n, sum(taxable_amount) AS sub, sum(quantity) AS q, min(product_id) FILTER (line_no = 1) AS p1 FROM lines GROUP BY 1)
SELECT o.bill, CASE WHEN o.bill % 3 <> 0 THEN 'INV-' || o.bill WHEN coded THEN 'QR' || o.bill END AS invoice_number, CASE WHEN o.bill % 4 <> 0 OR coded THEN day END AS invoice_date, CASE WHEN coded THEN 'irn' END AS irn, CASE WHEN o.bill % 5 <> 0 THEN 'Mill ' || cust END AS seller_name,
  CASE WHEN o.bill % 2 = 1 THEN '27S' || cust WHEN coded THEN '27Q' || cust END AS seller_gstin, CASE WHEN coded THEN '27B' || cust END AS buyer_gstin, CASE WHEN NOT (coded AND o.bill % 6 = 0) THEN 'Store' END AS consignee_name, CASE WHEN o.bill % 2 = 0 THEN '7 Days' END AS payment_terms,
  CASE o.bill % 7 WHEN 0 THEN '123456789012' WHEN 1 THEN '999' END AS eway_bill_no, coalesce(n, 0)::INTEGER AS n_lines, (1 + (o.bill % 2 = 0)::INT + (o.bill % 10 = 0)::INT)::INTEGER AS n_charges, nullif(sub, 0)::DOUBLE AS subtotal, 20::DOUBLE AS discount_total,
  CASE WHEN o.bill % 8 = 0 THEN total WHEN o.bill % 11 = 0 THEN 700 WHEN n > 0 THEN sub + CASE WHEN o.bill % 2 = 0 THEN 80 ELSE -20 END END::DOUBLE AS taxable_value, CASE WHEN o.bill % 9 = 1 THEN 5 ELSE o.bill % 100 END::DOUBLE AS igst_amount, CASE WHEN o.bill % 2 = 0 THEN 100 END::DOUBLE AS other_charges, CASE WHEN o.bill % 10 = 0 THEN 0.34 END::DOUBLE AS round_off,
  CASE WHEN o.bill % 3 = 1 THEN CASE WHEN coded THEN total ELSE 7 END ELSE total END::DOUBLE AS grand_total, q::DOUBLE AS total_quantity, CASE WHEN n > 0 THEN CASE WHEN n >= 1 THEN 'BAG' END END AS uom, CASE WHEN n > 0 THEN 3 END::DOUBLE AS total_bags,
  CASE WHEN o.bill % 2 = 0 THEN 'HDFC0001234' END AS ifsc, CASE WHEN o.bill % 3 = 0 THEN '1234' END AS account, CASE WHEN o.bill % 2 = 0 THEN 'Fort' END AS branch, CASE WHEN n > 0 THEN 7 END::INTEGER AS first_number
FROM o LEFT JOIN g USING (bill)"""
register("assembled_bills", BILLS)(
    lambda s, d: printed_bills(s, d).select(
        "bill", "invoice_number", "invoice_date", "irn", "seller_name", "seller_gstin", "buyer_gstin", "consignee_name", "payment_terms", "eway_bill_no", F.size("lines").alias("n_lines"), F.size("charges").alias("n_charges"),
        *(F.col(c).cast("double").alias(c) for c in ("subtotal", "discount_total", "taxable_value", "igst_amount", "other_charges", "round_off", "grand_total", "total_quantity", "total_bags")), "uom", F.col("bank.ifsc").alias("ifsc"), F.col("bank.account_number").alias("account"), F.col("bank.branch").alias("branch"), F.try_element_at("lines", F.lit(1))["line_no"].cast("int").alias("first_number")))
register("saved_pages", "SELECT doc_id AS document_id, 1 AS page_no, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS text_layer, CASE WHEN doc_id % 4 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS text_quality FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, 2, 'new', NULL FROM documents WHERE doc_id % 2 = 0")(
    lambda s, d: (lambda p: assembly.saved_pages(p.where("doc_id % 3 <> 2").selectExpr("doc_id AS document_id", "1 AS page_no", "CAST(NULL AS STRING) AS image_path", "'old' AS text_layer", "'' AS ocr_text", "0.5D AS text_quality"), p.where("doc_id % 3 <> 2").selectExpr("doc_id AS document_id", "1 AS page_no", "CAST(NULL AS STRING) AS image_path", "IF(doc_id % 2 = 0, 'new', '') AS text_layer", "'' AS ocr_text", "IF(doc_id % 4 = 0, 0.9D, NULL) AS text_quality").unionByName(p.where("doc_id % 2 = 0").selectExpr("doc_id AS document_id", "2 AS page_no", "CAST(NULL AS STRING) AS image_path", "'new' AS text_layer", "'' AS ocr_text", "CAST(NULL AS DOUBLE) AS text_quality"))))(Ledger(s, d).documents).select("document_id", "page_no", "text_layer", "text_quality"))
register("best_page_quality", "SELECT page_id % 20 AS document_id, coalesce(max(CASE WHEN page_id % 20 <> 3 THEN page_id END), 0)::DOUBLE AS quality FROM pages GROUP BY 1")(
    lambda s, d: assembly.best_quality(Ledger(s, d).pages.selectExpr("page_id % 20 AS document_id", "CAST(IF(page_id % 20 = 3, NULL, page_id) AS DOUBLE) AS text_quality")))
register("located_values", "SELECT p_partkey AS doc, p_partkey % 2 + 1 AS page, 2 AS line, 2 AS first, 3 AS last FROM part WHERE p_partkey % 5 <> 0")(
    lambda s, d: assembly.located(Ledger(s, d).part.selectExpr("p_partkey AS doc", "IF(p_partkey % 5 = 0, 'gone', concat('INV ', p_size)) AS needle", f"inline(flatten(transform(array(1, 2), p -> transform(array('No', 'in', concat('v', p_size), '1-Jul'), (w, i) -> struct(p AS page, 2 AS line, i + 1 AS place, IF(p < p_partkey % 2 + 1 AND i = 1, 'out', w) AS text)))))"), "needle"))

# --- Dictated deals ---------------------------------------------------------------------------------------------------

register("read_back", """WITH x AS (SELECT p_partkey AS id, p_size AS q, p_partkey % 4 AS k, CASE WHEN p_partkey % 4 = 3 THEN 'GONI' ELSE 'BAGS' END AS u FROM part)
SELECT id, CASE k WHEN 0 THEN 'Acme sold Bharat ' || q || ' bags of Cashew at 1,250 per bag — ' || CASE WHEN q * 1250 >= 100000 THEN '' ELSE '' END || CASE WHEN length((q * 1250)::VARCHAR) > 3 THEN (q * 1250 // 1000) || ',' || lpad((q * 1250 % 1000)::VARCHAR, 3, '0') ELSE (q * 1250)::VARCHAR END || '.' WHEN 1 THEN 'Sold to Bharat Cashew at 1,250 per bag.' WHEN 2 THEN 'Acme sold ' || q || ' bags.' ELSE 'Sold ' || q || ' goni of Cashew at 813 — ' || CASE WHEN length((q * 813)::VARCHAR) > 3 THEN (q * 813 // 1000) || ',' || lpad((q * 813 % 1000)::VARCHAR, 3, '0') ELSE (q * 813)::VARCHAR END || '.' END AS sentence FROM x""")(
    lambda s, d: of_part(s, d, sentence=spoken.read_back(F.expr("IF(p_partkey % 2 = 0, 'Acme', NULL)"), F.expr("IF(p_partkey % 4 < 2, 'Bharat', NULL)"), F.expr("IF(p_partkey % 4 = 2, NULL, 'Cashew')"), F.expr("CAST(IF(p_partkey % 4 = 1, NULL, p_size) AS DECIMAL(16,3))"), F.expr("IF(p_partkey % 4 = 3, 'GONI', 'BAGS')"), F.expr("CAST(CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 813 ELSE 1250 END AS DECIMAL(16,2))"))))
register("saved_trades", "SELECT p_partkey AS id, 'Acme Co' AS seller, CASE WHEN p_partkey % 2 = 0 THEN 'B' END AS buyer, (1000 + p_size)::DOUBLE AS quantity, 813::DOUBLE AS rate, ((1000 + p_size) * 813)::DOUBLE AS value, CASE WHEN p_partkey % 3 = 0 THEN DATE '2026-07-21' ELSE DATE '2026-07-01' END AS traded_on FROM part")(
    lambda s, d: spoken.saved(of_part(s, d, seller="' Acme  Co., '", buyer="IF(p_partkey % 2 = 0, 'B', ' . ')", goods="'x'", quantity="concat('1,0', lpad(CAST(p_size AS STRING), 2, '0'))", rate="'₹813'", traded_on="IF(p_partkey % 3 = 0, NULL, DATE '2026-07-01')"), "2026-07-21").select("id", "seller", "buyer", "quantity", "rate", F.col("value").cast("double").alias("value"), "traded_on"))
register("prompt_terms", "SELECT term, used FROM (SELECT p_name AS term, sum(length(p_name) + 1) OVER (ORDER BY p_partkey, p_name)::BIGINT AS used FROM part) WHERE used <= 110")(
    lambda s, d: spoken.fitting(Ledger(s, d).part.selectExpr("p_name AS term", "p_partkey AS n"), 110).select("term", "used"))
INDIC = {0: ("C{a} से V{b} को {q} बोरी काजू १२५० में", "C{a}", "V{b}", "Cashew", "BAGS", 1250), 1: ("C{a} pasethi V{b} ne {q} bori kali mirch 813 bhav", "C{a}", "V{b}", "Black pepper", "BAGS", 813), 2: ("C{a} ne V{b} ko {q} kilo sabut haldi 94 mein", "C{a}", "V{b}", "whole Turmeric", "KGS", 94), 3: ("V{b} ne {q} kilo badam 813 mein", None, "V{b}", "Almond", "KGS", 813)}
_parts = {"a": "(p_partkey % 90 + 10)", "b": "(p_partkey % 80 + 10)", "q": "(p_size % 90 + 10)"}


def _text(template: str | None, sql: bool) -> str:
    """An expression of a template: what is in braces are columns."""
    if template is None:
        return "NULL"
    out = "'" + template.replace("{", "', {").replace("}", "}, '") + "'"
    for k, v in _parts.items():
        out = out.replace("{" + k + "}", f"{v}::VARCHAR" if sql else f"CAST({v} AS STRING)")
    return f"concat({out})"


register("spoken_scripts", "SELECT p_partkey AS id, " + ", ".join(f"CASE p_partkey % 4 {' '.join(f'WHEN {k} THEN {_text(t[i], True)}' for k, t in INDIC.items())} END AS {c}" for i, c in ((1, "seller"), (2, "buyer"), (3, "goods"), (4, "uom"))) + f", {_parts['q']}::DOUBLE AS quantity, CASE p_partkey % 4 {' '.join(f'WHEN {k} THEN {t[5]}' for k, t in INDIC.items())} END::DOUBLE AS rate FROM part")(
    lambda s, d: sentences.deals(Ledger(s, d).part.selectExpr("p_partkey AS id", f"CASE p_partkey % 4 {' '.join(f'WHEN {k} THEN {_text(t[0], False)}' for k, t in INDIC.items())} END AS text")).select("id", "seller", "buyer", "goods", "uom", "quantity", "rate"))
register("word_roles", "SELECT p_partkey AS id, unnest([{'place': 1, 'word': 'C' || (p_size % 90 + 10), 'role': 'code'}, {'place': 2, 'word': 'ne', 'role': 'marks a buyer'}, {'place': 3, 'word': p_size::VARCHAR, 'role': 'number'}, {'place': 4, 'word': 'bori', 'role': 'unit'}, {'place': 5, 'word': 'kaju,', 'role': 'name or goods'}], recursive := true) FROM part")(
    lambda s, d: sentences.explained(Ledger(s, d).part.selectExpr("p_partkey AS id", "concat('haan C', p_size % 90 + 10, ' ne ', p_size, ' bori kaju,') AS text")).select("id", "place", "word", "role"))
register("snapped_deals", "SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' Mart' ELSE 'Qqqq' END AS seller, CASE WHEN c_custkey % 2 = 0 THEN lower(left(c_mktsegment, length(c_mktsegment) - 1)) || 'mart' END AS seller_heard, CASE WHEN c_custkey % 2 = 0 THEN least(0.85, 0.7 + 0.2) ELSE 0.7 END::DOUBLE AS seller_confidence, 'Cashew' AS goods FROM customer")(
    lambda s, d: (lambda c: resolving.snapped_deals(c.selectExpr("c_custkey AS ask_id", "IF(c_custkey % 2 = 0, concat(lower(left(c_mktsegment, length(c_mktsegment) - 1)), 'mart'), 'Qqqq') AS seller", "CAST(NULL AS STRING) AS buyer", "'Cashew' AS goods", "0.7D AS seller_confidence", "0.7D AS buyer_confidence", "0.7D AS goods_confidence"), c.selectExpr("concat(c_mktsegment, ' Mart') AS name").distinct(), c.sparkSession.createDataFrame([("Cashew",), ("Walnut",)], "name string"), matching.snapped))(Ledger(s, d).customer).select("ask_id", "seller", "seller_heard", "seller_confidence", "goods"))
