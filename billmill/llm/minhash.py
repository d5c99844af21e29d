"""Near copies by word shingles: MinHash bands bring candidates together, their exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, prepared, whole

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Bands and hashes of each: a pair at LEAST shares no band with probability (1 - 0.8 ** 4) ** 14 = 0.0006.
BANDS, DEPTH = 14, 4
#: Rows of a bucket's block: a larger bucket meets by pairs of blocks, a task a pair.
BLOCK = 2048
U = np.uint64


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words, lower case; of fewer words, the one of all."""
    words = (text or "").lower().split()
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.array([known[w] for w in words], U)
    size = min(size, len(h))
    n = len(h) - size + 1 if size else 0
    total = np.zeros(n, U)
    for k in range(size):  # the order of the words counts
        total = (total ^ (total >> U(29))) * U(0x9E3779B97F4A7C15) + h[k : k + n]
    total ^= total >> U(32)
    return np.unique(total * U(0xD6E8FEB86659FD93))


def bands(of: np.ndarray) -> list[int]:
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 63, BANDS * DEPTH, dtype=U)[:, None] for _ in range(2))
    least = np.full(BANDS * DEPTH, np.iinfo(U).max, U)
    for at in range(0, len(of), 4096):
        x = (of[None, at : at + 4096] ^ a) * (b | U(1))
        least = np.minimum(least, (x ^ (x >> U(31))).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), t) - (1 << 63) for t, part in enumerate(least.reshape(BANDS, DEPTH))]


def close(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def joined(sets: list[np.ndarray], blocks: list[int]) -> list[tuple[int, int]]:
    """Links that connect what the close pairs connect, of all pairs or, if there are two blocks, of those across them;
    pairs that are connected already aren't compared, so a group of near copies costs its size and not its square."""
    group, members, out = list(range(len(sets))), {i: [i] for i in range(len(sets))}, []
    split = blocks.index(blocks[-1])  # blocks are sorted; of one block, all rows are on both sides
    for i in range(split or len(sets)):
        for j in range(split or i + 1, len(sets)):
            if group[i] != group[j] and close(sets[i], sets[j]):
                out.append((i, j))
                a, b = sorted((group[i], group[j]), key=lambda g: -len(members[g]))
                for m in members[b]:
                    group[m] = a
                members[a] += members.pop(b)
        if len(members) == 1:
            break
    return out


def links(docs: DataFrame, id_col: str, text_col: str = "text", size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Links (u, v) that connect the rows of docs, by their ids (equal ids: equal rows), whose sets of shingles have a
    Jaccard similarity of least or more. Equal sets are one; candidates alone meet with their texts, once a shared band.
    Null and empty texts have the empty set, and are one; an empty table gives no rows; other columns are ignored."""
    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "key": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "bands": [bands(s) for s in sets]})

    made = cut(rows.mapInPandas(hashed, f"id {kind}, key binary, bands array<long>"))
    first = cut(made.groupBy("key").agg(F.min(F.struct("id", "bands")).alias("first")))
    copies = made.select("id", "key").join(first.select("key", F.col("first.id").alias("v")), "key").where("id <> v").select(F.col("id").alias("u"), "v").distinct()
    each = first.select("first.id", F.posexplode("first.bands").alias("t", "b"))
    # Bands often bring the same rows together; of such buckets one is enough.
    shared = each.groupBy("t", "b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).where("n > 1")
    shared = shared.groupBy("n", "who").agg(F.min(F.struct("t", "b")).alias("one")).select("one.*", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    candidates = cut(each.join(shared, ["t", "b"]))
    placed = rows.join(candidates, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.select("t", "b", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "text")
    met = tiles.repartition(partitions(docs), "t", "b", "one", "two").sortWithinPartitions("t", "b", "one", "two", "block", "id")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole(batches, ["t", "b", "one", "two"], 1):
            part = part[(part["id"] != part["id"].shift()).to_numpy()]
            if len(part) > 1 and (part["one"].iloc[0] == part["two"].iloc[0] or part["block"].nunique() == 2):
                ids = part["id"].tolist()
                found = joined([shingles(t, size) for t in part["text"]], part["block"].tolist())
                if found:
                    yield pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["u", "v"])

    return copies.unionByName(met.mapInPandas(compared, f"u {kind}, v {kind}"))
