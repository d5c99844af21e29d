"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups."""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepared

SEQ_LEN, END_ID, SEED = 2048, 1, 42
#: Documents of one group. Each group is packed on its own, so this bounds a task's memory.
GROUP_DOCS = 8192
#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The tokens that a JSON file adds to its vocabulary: its library finds them in text before anything is merged."""
    with open(vocabulary, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"only tokens that stand for just their letters are known, not {odd}")
    return {t["content"]: t["id"] for t in found}


def encoder(ranks: str, added: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """Ids of a text by a rank file; added tokens' strings in it get their ids, other special ones are ordinary text.

    A rank file has the vocabulary and merges of the JSON file of the same name and with that file's added_tokens()
    gives the same ids, five times as fast (the tests compare the two).
    """
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encode = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens=added or {})
    return partial(encode.encode, allowed_special="all") if added else encode.encode_ordinary


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; longest first, ties in the order given, each into the first bin with room.

    The tree's leaves are the bins' free capacities and each inner node has the larger of its children's, so the
    first bin with room is one walk from the root.
    """
    size = 1 << max(0, len(lengths) - 1).bit_length()
    tree, out = [capacity] * (2 * size), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, at = lengths[i], 1
        while at < size:
            at *= 2
            if tree[at] < need:
                at += 1
        out[i] = (at - size, capacity - tree[at])
        tree[at] -= need
        while at > 1:
            at //= 2
            larger = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == larger:
                break
            tree[at] = larger
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, ranks: str, seq_len: int, added: dict[str, int] | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) of every run of at most seq_len ids; a document ends with END_ID."""

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, step = encoder(ranks, added), 4 * seq_len
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                ids = array("I", [*encode(text or ""), END_ID]).tobytes()
                rows += [(key, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step]), len(ids) // 4) for at in range(0, len(ids), step)]
            out = pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.assign(id=out["id"].astype(batch["id"].dtype))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(cuts, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, group_docs: int = GROUP_DOCS, seed: int = SEED, added: dict[str, int] | None = None) -> DataFrame:
    """Every document's pieces with the sequence and offset that each has got.

    A document is cut into full pieces, each a sequence of its own, and one remainder. Remainders are dealt into
    random groups of about group_docs and packed there; added is that of encoder(). Null and empty texts are the end id alone; repeated rows are
    packed one by one; an empty table gives no rows; other columns are ignored. Columns: the id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.
    """
    prepared(docs.sparkSession)
    rows = cut(pieces(docs, id_col, text_col, ranks, seq_len, added)).withColumn("row", F.monotonically_increasing_id())
    full = rows.where(F.col("length") == seq_len).select("*", (F.lit(1 << 62).bitwiseOR(F.col("row"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < seq_len)
    groups = max(1, -(-rest.count() // group_docs))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True])
        found = first_fit_decreasing(group["length"].tolist(), seq_len)
        return group.assign(sequence_id=[int(g) << 32 | b for g, (b, _) in zip(group["grp"], found, strict=True)], offset=[o for _, o in found]).drop(columns="grp")

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema.fields)
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    out = full.unionByName(dealt.groupBy("grp").applyInPandas(packed, kinds))
    return out.withColumnRenamed("id", id_col).drop("row")
