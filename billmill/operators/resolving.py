"""Printed parties and goods to those of the ledger: found, created once, enriched, known by more names, merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import STATES, alnum_upper, category, hsn, lookup, name_key, product_key, product_label, unit
from .lifecycle import pan
from .matching import exact_tiers, fuzzy, token_set_ratio

# What is filled in from a bill where the ledger has nothing, and the roles of a party.
BLANKS = ("gstin", "pan", "fssai", "address", "city", "state_name", "state_code", "pincode", "phone", "email")
ROLES = ("seller", "buyer", "consignee", "transporter", "broker")
#: Least likeness of a product's name to one of the same code and grade.
PRODUCT_LIKE = 90.0


def tidy(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def found_parties(asked: DataFrame, parties: DataFrame, aliases: DataFrame, strict: bool = False) -> DataFrame:
    """asked (ask_id, name, gstin, state_code) with party_id and tier, nulls where nobody fits.

    After the exact tiers, the closest name of the same state, or of a party or a question without a state (88 at
    least, ties to the smaller id); two taxpayer numbers that differ rule that one out. With strict they also rule out
    what an alias or a name alone has found, so that one firm's registrations in two states stay apart.
    """
    number = alnum_upper(F.col("gstin"))
    exact = exact_tiers(asked, parties, aliases)
    left = asked.join(exact.where("party_id is null").select("ask_id"), "ask_id", "left_semi")
    near = fuzzy(left.select("ask_id", "name", F.col("state_code").alias("block")), parties.select("party_id", F.coalesce(F.nullif(F.col("display_name"), F.lit("")), "legal_name").alias("name"), F.col("state_code").alias("block")))
    numbers = parties.select("party_id", number.alias("theirs"))
    both = exact.where("party_id is not null").unionByName(near.select("ask_id", "party_id", F.lit("by_fuzzy").alias("tier")))
    judged = asked.select("ask_id", number.alias("ours")).join(both, "ask_id").join(numbers, "party_id")
    apart = F.coalesce(F.col("ours") != F.col("theirs"), F.lit(False)) & (F.lit(True) if strict else F.col("tier") == "by_fuzzy")
    return asked.select("ask_id").join(judged.where(~apart).select("ask_id", "party_id", "tier"), "ask_id", "left")


def resolved_parties(asked: DataFrame, parties: DataFrame, aliases: DataFrame, find: Callable[..., DataFrame] = found_parties) -> dict[str, DataFrame]:
    """What a batch of printed parties (ask_id, role, name, and any of BLANKS) makes of the ledger's.

    links: (ask_id, role, party_id, how). The state in a taxpayer number counts before a printed one. Those whom nobody
    fits are created, one for each taxpayer number, or else for each name key and state, with -(their first ask_id) for
    an id; asks without name and number have no party. parties: all, blanks filled by the first ask that has something
    (nothing known is replaced), with the roles they have had. aliases: other names that a party came by, and how often.
    """
    have = [b for b in BLANKS if b in asked.columns]
    clean = asked.select("ask_id", "role", tidy(F.col("name")).alias("name"), *(tidy(F.col(b)).alias(b) for b in have))
    for b in BLANKS:
        clean = clean if b in have else clean.withColumn(b, F.lit(None).cast("string"))
    clean = clean.withColumn("gstin", alnum_upper(F.col("gstin")))
    coded = F.when(F.substring("gstin", 1, 2).isin(*STATES), F.substring("gstin", 1, 2))
    clean = clean.withColumns({"state_code": F.coalesce(coded, "state_code"), "pan": F.coalesce(alnum_upper(F.col("pan")), pan(F.col("gstin"))), "state_name": F.coalesce("state_name", lookup(STATES)[coded])})
    clean = clean.where("name is not null or gstin is not null")
    hits = find(clean.select("ask_id", "name", "gstin", "state_code"), parties, aliases)
    identity = F.coalesce(F.concat(F.lit("g:"), F.col("gstin")), F.concat_ws(":", F.lit("n"), F.nullif(name_key(F.col("name")), F.lit("")), "state_code"))
    rows = clean.join(hits, "ask_id").withColumn("identity", identity)
    made = rows.where("party_id is null").groupBy("identity").agg((-F.min("ask_id")).alias("made"))
    rows = rows.join(made, "identity", "left").withColumns({"how": F.coalesce("tier", F.lit("created")), "party_id": F.coalesce("party_id", "made")})

    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ask_id"))).alias(f"_{c}")
    seen = rows.groupBy("party_id").agg(first("name"), *(first(b) for b in BLANKS), *(F.bool_or(F.col("role") == r).alias(f"_is_{r}") for r in ROLES))
    all_ = parties.join(seen, "party_id", "full")
    old = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in parties.columns else F.lit(None).cast("string")
    named = F.coalesce("legal_name", "_name", "_gstin")
    now = all_.select("party_id", named.alias("legal_name"), *(F.coalesce(old(b), F.col(f"_{b}")).alias(b) for b in BLANKS), *((F.coalesce(F.col(f"_is_{r}"), F.lit(False)) | (F.coalesce(F.col(f"is_{r}"), F.lit(False)) if f"is_{r}" in parties.columns else F.lit(False))).alias(f"is_{r}") for r in ROLES))
    keys = now.select("party_id", name_key(F.col("legal_name")).alias("own"))
    said = rows.where("name is not null").withColumn("key", name_key(F.col("name"))).where("key <> ''").join(keys, "party_id").where("key <> own")
    names = said.groupBy("party_id", "key").agg(F.min_by("name", "ask_id").alias("alias"), F.count("*").alias("seen_count"))
    return {"links": rows.select("ask_id", "role", "party_id", "how"), "parties": now, "aliases": names}


def found_products(asked: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (ask_id, description, remarks, hsn) with key, product_id and tier: an alias, a name, or the closest name
    of the same code and grade (a differing grade is another product; no code, no likeness), ties to the smaller id."""
    label = product_label(tidy(F.col("description")), tidy(F.col("remarks")))
    a = asked.withColumns({"label": label, "code": hsn(F.col("hsn")), "grade_key": product_key(F.col("remarks"))}).withColumn("key", F.nullif(product_key(F.col("label")), F.lit("")))
    one = lambda df, c: df.withColumn("_key", F.nullif(product_key(F.col(c)), F.lit(""))).where("_key is not null").groupBy("_key").agg(F.min("product_id").alias(f"by_{c}"))
    exact = a.join(one(aliases, "alias"), F.col("key") == F.col("_key"), "left").drop("_key").join(one(products, "name"), F.col("key") == F.col("_key"), "left").drop("_key")
    block = lambda code, grade: F.concat_ws("|", code, product_key(grade))
    left = exact.where("by_alias is null and by_name is null and code is not null").select("ask_id", F.col("label").alias("name"), block(F.col("code"), F.col("remarks")).alias("block"))
    known = products.where("hsn is not null").select(F.col("product_id").alias("party_id"), "name", block(hsn(F.col("hsn")), F.col("grade")).alias("block"))
    near = fuzzy(left, known, PRODUCT_LIKE, (product_key, product_key), lambda x, y: token_set_ratio(x[0], y[0])).select("ask_id", F.col("party_id").alias("by_fuzzy"))
    tiers = ["by_alias", "by_name", "by_fuzzy"]
    tier = F.coalesce(*(F.when(F.col(t).isNotNull(), F.lit(t)) for t in tiers))
    return exact.join(near, "ask_id", "left").select("ask_id", "label", "key", "code", F.coalesce(*tiers).alias("product_id"), tier.alias("tier"))


def resolved_products(asked: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ask_id, product_id, how, name, category, hsn, uom) of every line with a name; what isn't known is created, one
    for each key, with -(its first ask_id) for an id, and the category that key and code suggest."""
    rows = found_products(asked, products, aliases).where("key is not null")
    made = rows.where("product_id is null").groupBy("key").agg(F.min_by(F.struct("ask_id", "label", "code"), "ask_id").alias("made"))
    units = asked.select("ask_id", unit(F.col("uom")).alias("uom"))
    rows = rows.join(made, "key", "left").join(units, "ask_id").join(products.select("product_id", F.col("name").alias("known")), "product_id", "left")
    new = F.col("product_id").isNull()
    return rows.select("ask_id", F.coalesce("product_id", -F.col("made.ask_id")).alias("product_id"), F.coalesce("tier", F.lit("created")).alias("how"), F.when(new, F.col("made.label")).otherwise(F.col("known")).alias("name"), F.when(new, category(F.col("key"), F.coalesce("made.code", F.lit("")))).alias("category"), F.col("code").alias("hsn"), "uom")


def merged(facts: DataFrame, parties: DataFrame, aliases: DataFrame, pairs: DataFrame, roles: tuple[str, ...] = ROLES) -> dict[str, DataFrame]:
    """The ledger after pairs (keep, drop; no party in two) of parties became one, but for those whose taxpayer numbers
    differ, which are refused.

    facts: bills with the dropped parties' keys replaced in each role. parties: without them, with their roles, and
    their number where the kept one has none. aliases: (party_id, alias), their names too, but for the kept one's own.
    """
    numbers = parties.select("party_id", F.nullif(F.col("gstin"), F.lit("")).alias("g"))
    of = lambda c: numbers.select(F.col("party_id").alias(c), F.col("g").alias(f"g_{c}"))
    asked = pairs.where("keep <> drop").join(of("keep"), "keep").join(of("drop"), "drop")
    done = asked.where(F.coalesce(F.col("g_keep") == F.col("g_drop"), F.lit(True)))
    out = facts
    for r in roles:
        out = out.join(done.select(F.col("keep").alias("_k"), F.col("drop").alias("_d")), F.col(f"{r}_id") == F.col("_d"), "left").withColumn(f"{r}_id", F.coalesce("_k", f"{r}_id")).drop("_k", "_d")
    flags = [f"is_{r}" for r in roles if f"is_{r}" in parties.columns]
    moved = done.select(F.col("drop").alias("party_id"), F.col("keep"))
    gone = parties.join(moved, "party_id").groupBy("keep").agg(F.min("gstin").alias("_g"), *(F.bool_or(f).alias(f"_{f}") for f in flags)).withColumnRenamed("keep", "party_id")
    kept = parties.join(moved.select("party_id"), "party_id", "left_anti").join(gone, "party_id", "left")
    kept = kept.withColumns({"gstin": F.coalesce(F.nullif(F.col("gstin"), F.lit("")), "_g")} | {f: F.col(f) | F.coalesce(f"_{f}", F.lit(False)) for f in flags}).select(*parties.columns)
    names = aliases.select("party_id", "alias").unionByName(parties.select("party_id", F.col("legal_name").alias("alias")).join(moved.select("party_id"), "party_id", "left_semi"))
    names = names.join(moved, "party_id", "left").select(F.coalesce("keep", "party_id").alias("party_id"), "alias").withColumn("key", name_key(F.col("alias"))).where("key <> ''")
    own = kept.select("party_id", name_key(F.col("legal_name")).alias("key"))
    names = names.join(own, ["party_id", "key"], "left_anti").groupBy("party_id", "key").agg(F.min("alias").alias("alias"))
    refused = asked.where("g_keep <> g_drop").select("keep", "drop")
    return {"facts": out.select(*facts.columns), "parties": kept, "aliases": names.select("party_id", "alias"), "refused": refused}


def snapped_deals(deals: DataFrame, parties: DataFrame, goods: DataFrame, snap: Callable[..., DataFrame]) -> DataFrame:
    """deals (ask_id; seller, buyer, goods, each with a confidence) with heard names replaced by known ones; what was
    replaced is 0.2 surer, up to 0.85, and keeps what was heard as <field>_heard."""
    out = deals
    for f, known in (("seller", parties), ("buyer", parties), ("goods", goods)):
        hit = snap(out.select("ask_id", F.col(f).alias("heard")), known).select("ask_id", F.col("name").alias("_name"))
        changed = F.col("_name") != F.col(f)
        out = out.join(hit, "ask_id", "left").withColumns({f"{f}_heard": F.when(changed, F.col(f)), f"{f}_confidence": F.when(changed, F.least(F.lit(0.85), F.col(f"{f}_confidence") + 0.2)).otherwise(F.col(f"{f}_confidence"))}).withColumn(f, F.coalesce("_name", f)).drop("_name")
    return out
