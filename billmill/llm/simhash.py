"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, partitions, prepared, whole

SHINGLE, SEED, BITS, BUDGET = 4, 42, 64, 4
#: A bucket of more fingerprints than this is parted again by a second block of bits.
LARGE = 4096
#: Fingerprints that a task joins at a time, whole buckets.
JOINED = 1 << 18
#: Node pairs that the join expands at a time.
FRONTIER = 1 << 20
#: Subtree pairs with no more leaf pairs than this are compared leaf by leaf.
LEAVES = 48
U = np.uint64
#: Letters of the texts that are hashed at a time.
CHARACTERS = 1 << 21
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _lane(acc: np.ndarray | np.uint64, x: np.ndarray) -> np.ndarray:
    return _turn(acc + x * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of buf[start:end] for each pair, a vector operation for each length that occurs; buf: bytes, 8 to spare."""
    out, sizes = np.empty(len(starts), U), ends - starts
    order = np.argsort(sizes, kind="stable")
    words = np.ndarray((max(0, len(buf) - 7),), "<u8", buf, strides=(1,))
    halves = np.ndarray((max(0, len(buf) - 3),), "<u4", buf, strides=(1,))
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    with np.errstate(over="ignore"):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at, n = starts[rows := order[a:b]].copy(), int(sizes[order[a]])
            if n > 512:
                import xxhash

                out[rows] = [xxhash.xxh64_intdigest(buf[s : s + n].tobytes(), seed) for s in at]
                continue
            left = n
            if n >= 32:
                acc = [U(seed) + P1 + P2, U(seed) + P2, U(seed), U(seed) - P1]
                while left >= 32:
                    acc = [_lane(v, words[at + 8 * i]) for i, v in enumerate(acc)]
                    at, left = at + 32, left - 32
                h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
                for v in acc:
                    h = (h ^ _lane(U(0), v)) * P1 + P4
            else:
                h = np.full(len(rows), U(seed) + P5, U)
            h = h + U(n)
            while left >= 8:
                h = _turn(h ^ _lane(U(0), words[at]), 27) * P1 + P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _turn(h ^ (halves[at].astype(U) * P1), 23) * P2 + P3
                at, left = at + 4, left - 4
            while left:
                h = _turn(h ^ (buf[at].astype(U) * P5), 11) * P1
                at, left = at + 1, left - 1
            h = (h ^ (h >> U(33))) * P2
            h = (h ^ (h >> U(29))) * P3
            out[rows] = h ^ (h >> U(32))
    return out


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text. Words are split at ASCII white space, A-Z lower-cased; no word: zero."""
    split = [(t or "").encode().lower().split() for t in texts]
    out, some = np.zeros(len(split), U), [i for i, words in enumerate(split) if words]
    if not some:
        return out
    buf = np.frombuffer(b"\n".join(b" ".join(split[i]) for i in some) + bytes(8), np.uint8)
    gaps = np.flatnonzero((buf[:-8] == 32) | (buf[:-8] == 10))
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf) - 8]])
    n = np.array([len(split[i]) for i in some])
    first, each = np.cumsum(n) - n, np.maximum(1, n - shingle + 1)
    base = np.cumsum(each) - each
    lead = np.arange(each.sum()) - np.repeat(base - first, each)
    hashes = xxh64(buf, starts[lead], ends[lead + np.repeat(np.minimum(n, shingle), each) - 1], seed)
    # Eight bits at a time, one a byte lane; runs of at most 255 rows can't overflow a lane.
    runs = -(-each // 255)
    of = np.repeat(np.arange(len(each)), runs)
    run = base[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs))
    value = np.zeros(len(each), U)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> U(bit)) & U(0x0101010101010101), run)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), np.cumsum(runs) - runs, axis=0)
        for byte in range(8):
            value |= (2 * counts[:, byte] > each).astype(U) << U(8 * byte + bit)
    out[some] = value
    return out


class Forest:
    """Union-find over 0 to n - 1 for whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            if not (open_ := x != y).any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def trie_join(bucket: np.ndarray, keys: np.ndarray, budget: int = BUDGET, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of positions) of the links within each bucket: keys that differ in budget bits or fewer.

    The sorted keys of a bucket are the leaves of a binary trie; a node is a range of them. Pairs of nodes go down
    together, one bit at a time: children that differ in the bit add one to the pair's error, and a pair over the
    budget is dropped with all its leaves. A pair that can't exceed the budget any more, or of few leaves, ends there.
    """
    order = np.lexsort((keys, bucket))
    k, where = keys[order], bucket[order]
    forest = Forest(len(k))
    top = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(k) else np.array([], int)
    size = np.diff(np.append(top, len(k)))
    top, size = top[size > 1], size[size > 1]
    ones = {}

    def count(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((k >> U(bits - 1 - depth)) & U(1), dtype=np.int64)])
        return ones[depth]

    def leaves(a, a_n, b, b_n):
        n = a_n * b_n
        pair = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = a[pair] + at // b_n[pair], b[pair] + at % b_n[pair]
        near = (x != y) & (np.bitwise_count(k[x] ^ k[y]) <= budget)
        forest.link(x[near], y[near])

    def known(a, a_n, b, b_n):
        """Pairs of ranges that are in one component already."""
        runs = np.concatenate([[0], np.cumsum(forest.root[1:] != forest.root[:-1])])
        return (runs[a] == runs[a + a_n - 1]) & (runs[b] == runs[b + b_n - 1]) & (forest.root[a] == forest.root[b])

    stack = [(0, top, size, top, size, np.zeros(len(top), np.int64))] if len(top) else []
    while stack:
        depth, a, a_n, b, b_n, err = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(depth, *(x[half:] for x in (a, a_n, b, b_n, err))), (depth, *(x[:half] for x in (a, a_n, b, b_n, err)))]
            continue
        open_ = ~known(a, a_n, b, b_n)
        a, a_n, b, b_n, err = (x[open_] for x in (a, a_n, b, b_n, err))
        sure = err + bits - depth <= budget
        for s, s_n in ((a, a_n), (b, b_n)):  # all leaves of both link with each other
            wide = np.repeat(s[sure], s_n[sure])
            forest.link(wide, wide + np.arange(len(wide)) - np.repeat(np.cumsum(s_n[sure]) - s_n[sure], s_n[sure]))
        forest.link(a[sure], b[sure])
        few = ~sure & (a_n * b_n <= LEAVES)
        leaves(a[few], a_n[few], b[few], b_n[few])
        rest = ~sure & ~few
        a, a_n, b, b_n, err = (x[rest] for x in (a, a_n, b, b_n, err))
        if not len(a):
            continue
        c = count(depth)
        a1, b1 = c[a + a_n] - c[a], c[b + b_n] - c[b]
        a0, b0, same = a_n - a1, b_n - b1, a == b
        parts = [(a, a0, b, b0, err), (a + a0, a1, b + b0, b1, err), (a, a0, b + b0, b1, err + 1), (a + a0, a1, b, np.where(same, 0, b0), err + 1)]
        a, a_n, b, b_n, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (a_n > 0) & (b_n > 0) & (err <= budget) & ~((a == b) & (a_n == 1))
        stack.append((depth + 1, *(x[live] for x in (a, a_n, b, b_n, err))))
    tied = np.flatnonzero(forest.root != np.arange(len(k)))
    return order[tied], order[forest.root[tied]]


def blocks(width: int, n: int) -> list[tuple[int, int]]:
    """n blocks (shift, width) of the low width bits, from the top."""
    sizes = [width // n + (i < width % n) for i in range(n)]
    return [(width - sum(sizes[: i + 1]), s) for i, s in enumerate(sizes)]


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (u, v) that connect what the links of the distinct fingerprints prints.fp connect.

    Within the budget, two fingerprints agree in one of budget + 1 blocks of bits at least, so each block's values
    part the fingerprints into tries that can be joined by different tasks. A value with more than LARGE fingerprints
    is parted again by blocks of the other bits: nothing is left out, and no task gets a hot value whole.
    """
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("v")) for t, (s, w) in enumerate(blocks(BITS, budget + 1)))))
    rows = prints.select("fp", each.alias("b")).select("fp", "b.*")
    large = rows.groupBy("t", "v").count().where(F.col("count") > LARGE).select("t", "v", F.lit(True).alias("large"))
    rows = rows.join(large, ["t", "v"], "left")
    second = F.lit(None)
    for t, (s, w) in enumerate(blocks(BITS, budget + 1)):
        rest = F.shiftleft(F.shiftrightunsigned("fp", s + w), s).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << s) - 1))) if s + w < BITS else F.col("fp").bitwiseAND(F.lit((1 << s) - 1))
        parts = F.array(*(F.lit(i << 20).bitwiseOR(F.shiftrightunsigned(rest, s2).bitwiseAND(F.lit((1 << w2) - 1))) for i, (s2, w2) in enumerate(blocks(BITS - w, budget + 1), 1)))
        second = F.when(F.col("t") == t, parts).otherwise(second)
    rows = rows.select("t", "v", "fp", F.explode(F.when(F.col("large"), second).otherwise(F.array(F.lit(0).cast("long")))).alias("w"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole(batches, ["t", "v", "w"], JOINED):
            fp = part["fp"].to_numpy().view(U)
            bucket = part.groupby(["t", "v", "w"], sort=False).ngroup().to_numpy()
            a, b = trie_join(bucket, fp, budget)
            yield pd.DataFrame({"u": fp[a].view(np.int64), "v": fp[b].view(np.int64)}).drop_duplicates()

    return rows.repartition(partitions(rows), "t", "v", "w").sortWithinPartitions("t", "v", "w").mapInPandas(joined, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, budget: int = BUDGET) -> DataFrame:
    """(id, fingerprint, component_id) of every document; component_id is the least id that links reach.

    Equal fingerprints are one leaf of the tries, so copies cost nothing there. Null and empty texts have fingerprint
    zero and link like others; repeated rows come back repeated; a null id never is a component_id unless all ids are
    null; an empty table gives no rows; other columns are ignored.
    """
    prepared(docs.sparkSession)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            ends = np.cumsum([len(t or "") for t in texts]) // CHARACTERS  # a part of the batch at a time: there are ten arrays a word
            parts = [fingerprints(texts[a:z], shingle, seed) for a, z in zip([0, *(np.flatnonzero(np.diff(ends)) + 1)], [*(np.flatnonzero(np.diff(ends)) + 1), len(texts)], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "fp": np.concatenate(parts).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(hashed, f"id {kind}, fp long"))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    # A fingerprint's node begins with its least id, so the least node of a component says the component's id.
    node = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("fp").alias("fp"))
    nodes = prints.select("fp", node.alias("node"))
    ends = [nodes.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")) for end in "uv"]
    edges = links(prints, budget).join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    named = nodes.join(components(edges), "node", "left").select("fp", F.coalesce("component.id", "node.id").alias("component_id"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
