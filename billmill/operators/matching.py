"""Names to parties and products: exact tiers as joins, then fuzzy ones within blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.cleaning import alnum_upper, name_key, name_light


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: how much of both strings a longest common subsequence has."""
    return 200 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared words and shared words with either rest; 100 if one side's words are all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    shared = " ".join(both)
    left, right = (" ".join([*both, *sorted(s)]) for s in (x - y, y - x))
    return max(ratio(left, right), *((ratio(shared, left), ratio(shared, right)) if both else (0.0,)))


def closeness(a: tuple[str, str], b: tuple[str, str]) -> float:
    """Of two names, each an aggressive and a light key: the lower of the keys' best scores."""
    tight = lambda s: s.replace(" ", "")
    return min(max(token_set_ratio(p, q), ratio(tight(p), tight(q))) for p, q in zip(a, b, strict=True))


def exact_tiers(asked: DataFrame, parties: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (ask_id, name, gstin, state_code) with party_id and tier, the first that names one: taxpayer number,
    alias, a name key that one party has, name key and state that one party has. A tier is one join with one row a key;
    a name without a key (null, or a legal form alone) has no tier but the first."""
    one = lambda df, key, *more: df.groupBy(F.col(key).alias(f"_{key}"), *more).agg(F.min("party_id").alias("_id"), F.countDistinct("party_id").alias("_n"))
    key = lambda c: F.nullif(name_key(F.col(c)), F.lit(""))
    keyed = parties.withColumns({"key": key("legal_name"), "number": alnum_upper(F.col("gstin"))})
    a = asked.withColumns({"key": key("name"), "number": alnum_upper(F.col("gstin"))})
    numbers = one(keyed.where("number is not null"), "number").select("_number", F.col("_id").alias("by_gstin"))
    known_as = one(aliases.withColumn("key", key("alias")).where("key is not null"), "key").select("_key", F.col("_id").alias("by_alias"))
    names = one(keyed.where("key is not null"), "key").where("_n = 1").select("_key", F.col("_id").alias("by_name"))
    placed = one(keyed.where("key is not null and state_code is not null"), "key", F.col("state_code").alias("_state")).where("_n = 1").select("_key", "_state", F.col("_id").alias("by_state"))
    out = a.join(numbers, F.col("number") == F.col("_number"), "left")
    for tier in (known_as, names):
        out = out.join(tier, F.col("key") == F.col("_key"), "left").drop("_key")
    out = out.join(placed, (F.col("key") == F.col("_key")) & (F.col("state_code") == F.col("_state")), "left")
    tiers = ["by_gstin", "by_alias", "by_name", "by_state"]
    tier = F.coalesce(*(F.when(F.col(t).isNotNull(), F.lit(t)) for t in tiers))
    return out.select("ask_id", F.coalesce(*tiers).alias("party_id"), tier.alias("tier"))


def fuzzy(asked: DataFrame, known: DataFrame, least: float = 88.0, keys: tuple[Callable[[Column], Column], ...] = (name_key, name_light), score_of: Callable[[tuple, tuple], float] = closeness) -> DataFrame:
    """(ask_id, party_id, score): the closest known name of least or more, ties to the smaller id.

    Both sides are (id, name, block). A name meets the names of its block and those without one; without a block it
    meets all. Each spelling of a block is scored once, against the spellings that share a word of the key with it, or
    of which least (80 at least) of the letters are common, in order: of the keys without blanks, or of their words in
    order. Such names of n and m letters differ by d insertions and deletions of a letter at most. Cut one into pieces
    0 to d: the first piece i that ends i differences or fewer is unharmed and has i before it and d - i or fewer behind
    it, which says where the other name has it. Names meet by length, piece and place, and part again where they differ
    by more than d even if letters may be replaced; no other spelling can reach least. What has no key (only a legal
    form, or nothing) matches nothing. score_of gets (key, light) of either side and has to be 0 to 100, and at most
    what the keys' words and letters allow. Names that are cut are many times their tables, so they are never broadcast.
    """
    if least < 80:
        raise ValueError("least has to be 80 or more")
    shortest = least / (200 - least)

    def spellings(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("key", keys[0](F.col("name"))).where("key <> ''")
        keyed = keyed.withColumn("words", F.array_distinct(F.filter(F.split("key", " "), lambda w: w != "")))
        return keyed.withColumns({"tight": F.regexp_replace("key", " ", ""), "set": F.array_join(F.array_sort("words"), " ")})

    def lengths(n: Column) -> Column:
        return F.sequence(F.ceil(n * shortest - 1e-9).cast("int"), F.floor(n / shortest + 1e-9).cast("int"))

    def differences(n: Column, m: Column) -> Column:
        """Of near names of n and m letters: so many, or fewer by an even number."""
        most = F.floor((1 - least / 100) * (n + m) + 1e-9).cast("int")
        return most - F.pmod(most + n + m, F.lit(2))

    def meets(df: DataFrame, where: Column, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A row a word and a piece, by a hash of where it is met. Rows are made one explode after the other, so that they are compiled."""
        placed, rest = df.withColumn("where", F.explode(where)), [c for c in df.columns if c not in ("words", "tight", "set")]
        texts = placed.withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in (("t", "tight"), ("s", "set")))))).select("where", *rest, "x.*")
        by_piece = cut(texts.withColumn("n", F.length("text"))).withColumn("k", F.xxhash64("where", "kind", "m", "at", "piece")).select("k", *rest, "text", "d")
        by_word = placed.select("where", *rest, F.explode("words").alias("w")).select(F.xxhash64("where", F.lit("w"), "w").alias("k"), *rest, F.lit(None).cast("string").alias("text"), F.lit(0).alias("d"))
        return by_piece.unionByName(by_word)

    def pieces(texts: DataFrame) -> DataFrame:
        """Where names of each length have to have this one's pieces."""
        i, n, m, d, by = (F.col(c) for c in ("i", "n", "m", "d", "by"))
        start = lambda i: F.floor(i * n / (d + 1)).cast("int")
        moved = texts.withColumn("m", F.explode(lengths(n))).withColumn("d", differences(n, m)).withColumn("i", F.explode(F.sequence(F.lit(0), d))).withColumn("by", F.explode(F.sequence(-i, i, F.lit(2))))
        fits = moved.where((F.abs(m - n - by) <= d - i) & (start(i) + by >= 0) & (start(i + 1) + by <= m))
        return fits.withColumns({"at": start(i) + by, "piece": F.substring("text", start(i) + 1, start(i + 1) - start(i))})

    def runs(texts: DataFrame) -> DataFrame:
        """This name's pieces of all sizes that a near name is cut into."""
        size = lambda n: n / (differences(n, F.col("m")) + 1)
        sizes = F.array_distinct(F.flatten(F.transform(lengths(F.col("m")), lambda n: F.array(F.floor(size(n)).cast("int"), F.ceil(size(n)).cast("int")))))
        sized = texts.withColumnRenamed("n", "m").withColumn("z", F.explode(sizes)).where("z <= m").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("z"))))
        return sized.withColumns({"piece": F.substring("text", F.col("at") + 1, F.col("z")), "d": F.lit(0)})

    # Blocks meet in one place each: equal ones, a known name without one, an asked name without one.
    some, others = asked.schema["block"].nullable, known.schema["block"].nullable
    own, free, every = F.struct(F.lit(0).alias("k"), F.col("block").alias("b")), *(F.struct(F.lit(k).alias("k"), F.lit(None).cast(asked.schema["block"].dataType).alias("b")) for k in (1, 2))
    null_safe = lambda c: F.struct(c["k"].alias("k"), c["b"].isNull().alias("n"), F.coalesce(c["b"].cast("string"), F.lit("")).alias("b"))
    at = lambda none, some: F.transform(F.when(F.col("block").isNull(), F.array(*none)).otherwise(F.array(*some)), null_safe)
    cores = asked.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df: df.repartition(cores, "name", "block")  # noqa: E731  # few rows become many, so they are not left to one task
    a = meets(spellings(dealt(asked.select("name", "block")).distinct()).drop("key"), at([every], [own, free] if others else [own]), pieces)
    k = meets(spellings(dealt(known.select("name", "block", "party_id")).groupBy("name", "block").agg(F.min("party_id").alias("party_id"))).drop("key"), at([free, every] if some else [free], [own, every] if some else [own]), runs)
    k = k.select("k", "party_id", F.col("name").alias("other"), F.col("block").alias("other_block"), F.col("text").alias("other_text"))
    near = F.col("text").isNull() & F.col("other_text").isNull() | F.expr("levenshtein(text, other_text, d) >= 0")
    same = F.coalesce(F.col("block") == F.col("other_block"), F.lit(True))  # two places can share a hash
    pairs = a.join(k.hint("merge"), "k").where(near & same).select("name", "block", "party_id", "other").distinct()
    pairs = pairs.withColumns({"key": keys[0](F.col("name")), "light": keys[1](F.col("name")), "other_key": keys[0](F.col("other")), "other_light": keys[1](F.col("other"))})

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = lru_cache(1 << 16)(score_of)
        for b in batches:
            yield b[["name", "block", "party_id"]].assign(score=[score((x, n), (y, o)) for x, n, y, o in zip(b["key"], b["light"], b["other_key"], b["other_light"], strict=True)])

    hits = pairs.mapInPandas(scored, f"name string, block {asked.schema['block'].dataType.simpleString()}, party_id long, score double").where(F.col("score") >= least)
    best = hits.groupBy(F.col("name").alias("_name"), F.col("block").alias("_block")).agg(F.max_by("party_id", F.struct("score", -F.col("party_id"))).alias("party_id"), F.max("score").alias("score"))
    return asked.join(best, (F.col("name") == F.col("_name")) & F.col("block").eqNullSafe(F.col("_block"))).groupBy("ask_id").agg(F.max_by("party_id", F.struct("score", -F.col("party_id"))).alias("party_id"), F.max("score").alias("score"))


def snapped(asked: DataFrame, known: DataFrame, least: float = 65.0, margin: float = 6.0) -> DataFrame:
    """asked (ask_id, heard) with name: the known name (name) that heard stands for, if it is close, and closer than the
    next one by the margin; else heard. Latin letters and digits count, whatever their case; three of them at least.

    Each spelling is scored once, and only against names of a length that allows a score of least - margin; others
    can neither win nor stand in a winner's way (least has to be above margin). Lengths meet by bands, 1.25 times as long each.
    """
    tight = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    shortest = (least - margin) / (200 - (least - margin))
    band, reach = lambda c: F.floor(F.log(F.length(c)) / math.log(1.25)), math.ceil(-math.log(shortest) / math.log(1.25))
    said = asked.select("heard").where("heard is not null").distinct().withColumn("h", tight(F.col("heard"))).where(F.length("h") >= 3)
    said = said.withColumn("band", F.explode(F.sequence(band("h") - reach, band("h") + reach)))
    names = known.select("name").where("name is not null").distinct().withColumn("k", tight(F.col("name"))).where("k <> ''").withColumn("band", band("k"))
    of_length = F.least(F.length("h"), F.length("k")) >= shortest * F.greatest(F.length("h"), F.length("k"))
    pairs = said.join(names, "band").where(of_length).select("heard", "h", "name", "k")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"heard": b["heard"], "name": b["name"], "score": [ratio(x, y) for x, y in zip(b["h"], b["k"], strict=True)]})

    best = Window.partitionBy("heard").orderBy(F.desc("score"), F.desc("name"))
    ranked = pairs.mapInPandas(scored, "heard string, name string, score double").withColumns({"n": F.row_number().over(best), "next": F.lead("score").over(best)}).where("n = 1")
    clear = ranked.where((F.col("score") == 100) | ((F.col("score") >= least) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin))).select("heard", F.col("name").alias("_name"))
    return asked.join(clear, "heard", "left").withColumn("name", F.coalesce("_name", "heard")).drop("_name")


def first_of_content(docs: DataFrame, id_col: str, content: str) -> DataFrame:
    """The first row of each content hash, and how many have it."""
    return docs.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
