"""Exact top-k by integer inner product: descending norms, rotated partial sums, Cauchy-Schwarz residual bounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, prepared
from .vectors import finite, gram, matrix, width_of

K, SCALE = 5, 256
#: Vectors of a packed block, queries of one task, and candidate blocks that one task streams at most.
BLOCK, ASKED, STRIPE = 2048, 8192, 24
#: Vectors with a component over this are scored in Python's integers (the bound is lower if they are over 512 wide).
LARGEST = float(1 << 22)
#: What a long holds.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Share of the rotated coordinates that the first partial sum has.
HEAD = 0.25


def rotation(gram_matrix: np.ndarray) -> np.ndarray:
    """Right singular vectors of the data, by falling singular value: most of an inner product is in the first ones."""
    values, vectors = np.linalg.eigh(gram_matrix)
    return vectors[:, np.argsort(-values)]


class Best:
    """The k best (score, smaller id, smaller row) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.key, self.row = k, np.full((n, k), -(1 << 62)), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def offer(self, q: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        who = np.concatenate([np.repeat(touched, self.k), q])
        s, i, r = (np.concatenate([mine[touched].ravel(), new]) for mine, new in ((self.score, score), (self.key, key), (self.row, row)))
        order = np.lexsort((r, i, -s, who))
        who = who[order]
        rank = np.arange(len(who)) - np.repeat(np.flatnonzero(np.diff(who, prepend=-1)), np.diff(np.append(np.flatnonzero(np.diff(who, prepend=-1)), len(who))))
        keep = rank < self.k
        for mine, new in ((self.score, s), (self.key, i), (self.row, r)):
            mine[who[keep], rank[keep]] = new[order][keep]

    def threshold(self) -> np.ndarray:
        return np.where(self.row[:, -1] >= 0, self.score[:, -1].astype(float), -np.inf)


def search(q: np.ndarray, q_row: np.ndarray, known: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], turn: np.ndarray, k: int) -> Best:
    """The best k of the blocks (vectors, keys, rows; longest vectors first) for each query; integers in doubles. known:
    scores that k candidates reach in any case."""
    best, head = Best(len(q), k), max(1, round(q.shape[1] * HEAD))
    turned = q @ turn
    q_head, q_rest, q_norm = turned[:, :head], np.linalg.norm(turned[:, head:], axis=1), np.linalg.norm(q, axis=1)
    for c, key, row in blocks:
        longest, least = np.linalg.norm(c[0]), np.maximum(best.threshold(), known)  # the block's longest comes first
        slack = 1e-6 + longest * q.shape[1] * 2.0**-50
        open_ = np.flatnonzero(q_norm * (longest + slack) + slack >= least)
        if not len(open_):
            if np.isfinite(least).all():
                break  # every vector to come is shorter still
            continue
        rotated = c @ turn
        c_rest = np.linalg.norm(rotated[:, head:], axis=1)
        for at in range(0, len(open_), 256):
            part = open_[at : at + 256]
            bound = q_head[part] @ rotated[:, :head].T + q_rest[part][:, None] * c_rest[None, :] + slack * (1 + q_norm[part][:, None])
            if not np.isfinite(least[part]).all():  # no threshold yet: the scores of this block give one
                scores = q[part] @ c.T
                scores[q_row[part][:, None] == row[None, :]] = -np.inf
                if scores.shape[1] > k:
                    least[part] = np.maximum(least[part], np.partition(scores, -k, axis=1)[:, -k])
            i, j = np.nonzero((bound >= least[part][:, None]) & (q_row[part][:, None] != row[None, :]))
            score = np.empty(len(i), np.int64)
            for a in range(0, len(i), 1 << 16):
                score[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[part[i[a : a + (1 << 16)]]], c[j[a : a + (1 << 16)]]).astype(np.int64)
            keep = score >= least[part[i]]
            best.offer(part[i[keep]], score[keep], key[j[keep]], row[j[keep]])
    return best


def sortable(score: int) -> bytes:
    """Bytes in the order of the integers: how many there are, then the digits."""
    n = abs(score).bit_length() // 8 + 1
    return (32768 + n).to_bytes(2) + score.to_bytes(n) if score >= 0 else (32768 - n).to_bytes(2) + (score + (1 << 8 * n)).to_bytes(n)


def scaled(score: int, power: int) -> float:
    """score / 2 ** power, or a little less; infinite if no double has it."""
    cut_off = max(0, abs(score).bit_length() - 50)
    try:
        return math.ldexp(float(score >> cut_off), cut_off - power)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def search_large(q: np.ndarray, q_row: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[list[tuple[int, int, int]]]:
    """The best k (minus score, key, row) for each query, whatever the integers' size: doubles on a scale of their own
    rule out what is below the k-th best by more than their error, and Python's integers score the rest."""
    if not np.isfinite(q).all():
        raise OverflowError("a component times scale is no double")
    best: list[list[tuple[int, int, int]]] = [[] for _ in q]
    q_ints, q_power = [[int(x) for x in v] for v in q], np.frexp(np.abs(q).max(axis=1))[1]
    q_near = np.ldexp(q, -q_power[:, None])
    q_wide = np.linalg.norm(q_near, axis=1) * (q.shape[1] + 8) * 2.0**-50
    for c, key, row in blocks:
        if not np.isfinite(c).all():
            raise OverflowError("a component times scale is no double")
        # Of equal vectors, the first k but for the query itself are enough.
        same = np.unique(c, axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((row, key, same))
        first = np.flatnonzero(np.diff(same[order], prepend=-1))
        order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) <= k]
        c, key, row = c[order], key[order], row[order]
        c_power = int(np.frexp(np.abs(c).max())[1])
        c_near, c_ints = np.ldexp(c, -c_power), {}
        c_norm = np.linalg.norm(c_near, axis=1)
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            near, wide = q_near[part] @ c_near.T, q_wide[part][:, None] * c_norm[None, :] + 1e-290
            other = q_row[part][:, None] != row[None, :]
            least = np.array([scaled(-b[-1][0], int(e) + c_power) if len(b) == k else -np.inf for b, e in zip(best[part], q_power[part], strict=True)])
            low = np.where(other, near - wide, -np.inf)
            if low.shape[1] >= k:
                least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
            for i, j in zip(*np.nonzero((near + wide >= least[:, None]) & other), strict=True):
                if j not in c_ints:
                    c_ints[j] = [int(x) for x in c[j]]
                best[at + i].append((-sum(map(mul, q_ints[at + i], c_ints[j])), int(key[j]), int(row[j])))
            for i in range(at, min(at + 256, len(q))):
                best[i] = sorted(best[i])[:k]
    return best


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, every: int = 50) -> DataFrame:
    """query_id, rank, the id and score of the k best other rows for each row of vectors whose id every divides.

    A component counts as floor(scale * x). queries is vectors or a part of it; its rows are known by id, so every
    row of vectors with such an id is a query. Ties go to the smaller id (null last), then to the earlier row. Vectors
    null or with null or non-finite components take no part; shorter vectors are filled up
    with zeros; those with a component beyond LARGEST are ranked exactly too, and a score that no long holds is null; rows repeated under one id are each other's candidates; an empty table gives no rows; other columns
    are ignored. Candidates are sorted by length once, packed in blocks, and each group of queries meets those that are
    long enough for it, in that order, in shares of STRIPE blocks at most; only a share's k best leave its task.
    """
    prepared(vectors.sparkSession)
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    ints = F.transform(F.col(vector_col).cast("array<double>"), lambda x: whole(x * scale))
    all_rows = cut(vectors.where(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), ints.alias("v")).withColumn("row", F.monotonically_increasing_id()))
    width = max(1, width_of(all_rows, "v"))
    is_large = F.exists("v", lambda x: F.abs(x) > min(LARGEST, math.isqrt((1 << 53) // width)))
    rows, large = all_rows.where(~is_large), all_rows.where(is_large)
    turn = rotation(gram(rows, "v", width))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    ids = queries.select(F.col(id_col).cast("long").alias("id")).distinct()
    asking = lambda df: df.where(F.pmod("id", F.lit(every)) == 0) if queries is vectors else df.where(F.pmod("id", F.lit(every)) == 0).join(ids, "id", "left_semi")

    layout, result = "longest double, vectors binary, ids binary, rows binary, known binary", "query_id long, query_row long, key long, row long, score long, wide binary"
    cores = vectors.sparkSession.sparkContext.defaultParallelism

    def packed(part: pd.DataFrame, kind: type) -> pd.DataFrame:
        ids = part["id"].astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        return pd.DataFrame({"longest": [part["norm"].iloc[0]], "vectors": [matrix(part["v"], width, kind).tobytes()], "ids": [ids.tobytes()], "rows": [part["row"].to_numpy(np.int64).tobytes()], "known": [part["known"].fillna(-np.inf).to_numpy(np.float64).tobytes()]})

    def near(q: np.ndarray, q_ids: np.ndarray, q_rows: np.ndarray, known: np.ndarray, blocks: Iterator) -> pd.DataFrame:
        best = search(q, q_rows, known, blocks, turn, k)
        i, j = np.nonzero(best.row >= 0)
        return pd.DataFrame({"query_id": q_ids[i], "query_row": q_rows[i], "key": best.key[i, j], "row": best.row[i, j], "score": best.score[i, j], "wide": None})

    def far(q: np.ndarray, q_ids: np.ndarray, q_rows: np.ndarray, known: np.ndarray, blocks: Iterator) -> pd.DataFrame:
        best = search_large(q, q_rows, blocks, k)
        out = [(q_ids[i], q_rows[i], key, row, min(max(-s, LEAST), MOST), None if LEAST < -s < MOST else sortable(-s)) for i, b in enumerate(best) for s, key, row in b]
        return pd.DataFrame(out, columns=["query_id", "query_row", "key", "row", "score", "wide"])

    def blocks_of(df: DataFrame, kind: type, size: int) -> DataFrame:
        """df's vectors, size to a row, in the order they come."""

        def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for batch in batches:
                held.append(batch)
                while sum(map(len, held)) >= size:
                    all_ = pd.concat(held)
                    yield packed(all_[:size], kind)
                    held = [all_[size:]]
            if sum(map(len, held)):
                yield packed(pd.concat(held), kind)

        return df.mapInPandas(blocked, layout).withColumn("block", F.monotonically_increasing_id())

    def by_length(df: DataFrame, kind: type) -> tuple[DataFrame, int]:
        """Candidates in blocks by falling length, and how many blocks."""
        shares = max(1, -(-df.count() // (BLOCK * 4)))
        ordered = df.withColumn("norm", norm).withColumn("known", F.lit(None).cast("double")).repartitionByRange(shares, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
        made = cut(blocks_of(ordered, kind, BLOCK))
        return made, made.count()

    def grouped(df: DataFrame, kind: type) -> DataFrame:
        """Queries in groups by rising norm, which here is the length that a candidate of use has at least."""
        shares = max(1, -(-df.count() // ASKED))
        return cut(blocks_of(df.repartitionByRange(shares, "norm", "row").sortWithinPartitions("norm", "row"), kind, ASKED))

    def meeting(asked: DataFrame, blocks: DataFrame, n_blocks: int, kind: type, find: Callable[..., pd.DataFrame]) -> DataFrame:
        """What find makes of groups of queries and blocks. A task has a group and every stripes-th block that the group
        needs, longest first; blocks too short for all of its queries aren't sent."""
        needs = asked.select("block", "longest").collect()  # 16 bytes for ASKED queries
        stripes = max(1, -(-n_blocks // STRIPE), min(n_blocks, -(-2 * cores // max(1, len(needs)))))
        # Block numbers have their partition above bit 33, and a partition has about four blocks: this deals them in turn.
        groups = F.lit([r["block"] for r in needs]).cast("array<long>")
        least = F.transform(F.lit([r["longest"] for r in needs]).cast("array<double>"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        columns = ("longest", "vectors", "ids", "rows", "known")
        left = asked.select((F.array_position(groups, F.col("block")) - 1).cast("int").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(True).alias("is_query"), *columns)
        wanted = F.transform(F.filter(least, lambda z: z["x"] <= F.col("longest")), lambda z: z["i"])
        right = blocks.select(F.explode(wanted).alias("asked"), F.pmod(F.shiftright("block", 33) * 5 + F.col("block").bitwiseAND((1 << 33) - 1), F.lit(stripes)).cast("int").alias("stripe"), F.lit(False).alias("is_query"), *columns)
        task = F.col("asked").cast("long") * stripes + F.col("stripe")
        tasks = left.unionByName(right).withColumn("task", task).repartitionByRange(max(1, min(len(needs) * stripes, 16 * max(cores, partitions(blocks)))), "task")
        tasks = tasks.sortWithinPartitions("task", F.desc("is_query"), F.desc("longest")).drop("task")

        def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def parts():
                for batch in batches:
                    for r in batch.itertuples(index=False):
                        v = np.frombuffer(r.vectors, kind).reshape(-1, width).astype(np.float64)
                        yield (r.asked, r.stripe), r.is_query, v, np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64), np.frombuffer(r.known)

            for _, part in groupby(parts(), key=lambda p: p[0]):
                _, is_query, *query = next(part)
                if is_query:
                    yield find(*query, (p[2:5] for p in part))

        return tasks.mapInPandas(met, result)

    blocks, n_blocks = by_length(rows, np.int32)
    queries_ = asking(rows)
    unknown = lambda df: df.withColumn("norm", F.lit(float("-inf"))).withColumn("known", F.lit(None).cast("double"))
    # A look at the longest vectors gives each query a score that k of them reach, and so the length that others need.
    longest = blocks.orderBy(F.desc("longest")).limit(1)
    seen = meeting(grouped(unknown(queries_), np.int32), longest, 1, np.int32, near).groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("known")).where(F.col("n") >= k).drop("n")
    reach = F.when((norm > 0) & F.col("known").isNotNull(), F.col("known") / norm - 1e-6 * (1 + F.abs(F.col("known") / norm))).otherwise(F.lit(float("-inf")))
    asked = queries_.join(seen, "row", "left").withColumn("norm", reach)
    found = meeting(grouped(asked, np.int32), blocks, n_blocks, np.int32, near)
    if not large.isEmpty():
        far_blocks, n_far = by_length(large, np.float64)
        exact, _ = by_length(rows, np.float64)
        found = found.unionByName(meeting(grouped(unknown(asking(all_rows)), np.float64), far_blocks, n_far, np.float64, far))
        found = found.unionByName(meeting(grouped(unknown(asking(large)), np.float64), exact, n_blocks, np.float64, far))
    order = (F.desc("score"), F.desc_nulls_last("wide"), F.asc("key"), F.asc("row"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order))).where(F.col("rank") <= k)
    id_ = F.when(F.col("key") < F.lit(int(np.iinfo(np.int64).max)), F.col("key"))
    held = F.when(F.col("wide").isNull() | F.col("wide").isin(bytearray(sortable(LEAST)), bytearray(sortable(MOST))), F.col("score"))
    return ranked.select("query_id", "rank", id_.alias(id_col), held.alias("score"))
