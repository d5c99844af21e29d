"""Embedding near-duplicates: randomised-rotation binary codes with correction factors and confidence bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, partitions, prepared, whole
from .simhash import Forest
from .vectors import finite, matrix, width_of

COSINE, SEED = 0.95, 42
#: Independent rotations of a code: more of them narrow the estimate.
ROTATIONS = 4
#: Half-width of the confidence interval, in standard errors: one pair in thousands leaves it.
SIGMAS = 4.0
#: Mean size of an index bucket, and the share of linked pairs that no table may bring together.
BUCKET, MISSED = 32, 0.001
#: Rows of a bucket that meet at a time, rows of a bucket's block, and how many buckets beyond one block may be broadcast.
STEP, SPLIT, FEW = 1024, 8192, 10_000


def rotations(width: int, n: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """n random orthogonal matrices of the width, side by side."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.standard_normal((width, width)))
        out.append(q * np.sign(np.diag(r)))
    return np.hstack(out)


def tables(rows: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a bucket's key, and tables: two vectors at the least cosine meet in some table but MISSED of the time."""
    bits = max(4, round(math.log2(max(1, rows) / BUCKET)))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - meet))


def planes(width: int, bits: int, n: int, seed: int = SEED) -> np.ndarray:
    """The hyperplanes whose sides make the keys: width x (n * bits)."""
    return np.random.default_rng(seed + 1).standard_normal((width, n * bits))


def keys(unit: np.ndarray, normals: np.ndarray, bits: int) -> np.ndarray:
    """A key for each row and table."""
    sides = (unit @ normals > 0).reshape(len(unit), -1, bits)
    return sides @ (1 << np.arange(bits, dtype=np.int64))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (-1, 1) of the rotated rows, and for each rotation the row's inner product with its own code."""
    width = unit.shape[1]
    turned = unit @ turn
    signs = np.where(turned > 0, 1.0, -1.0)
    return signs, np.abs(turned).reshape(len(unit), -1, width).sum(axis=2) / math.sqrt(width)


def estimate(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of coded rows' inner products with raw rotated rows, and half-widths of their intervals.

    One rotation's estimate is <code, y> / <code, x>; its error has variance (1 - f^2) / f^2 / (width - 1) with
    f = <code, x>. Estimates of several rotations are averaged.
    """
    n = factors.shape[1]
    width = signs.shape[1] // n
    scale = np.repeat(1 / factors, width, axis=1) / (n * math.sqrt(width))
    error = np.sqrt(((1 - factors**2).clip(0) / factors**2).sum(axis=1) / max(1, width - 1)) / n
    return (signs * scale) @ turned.T, SIGMAS * error


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a and b in double precision, on vectors scaled by their largest component."""
    a, b = (m / np.abs(m).max(axis=1, keepdims=True) for m in (a, b))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


class Coded:
    """Vectors with their codes, correction factors and rotated forms."""

    def __init__(self, raw: np.ndarray, turn: np.ndarray):
        self.raw = raw
        unit = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        self.signs, self.factors = encode(unit, turn)
        self.turned = unit @ turn


def linked(coded: Coded, key: np.ndarray, table: int, cosine: float, own: range, others: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows, i in own and j in others, that link and that no earlier table has brought together."""
    for a in range(own.start, own.stop, STEP):
        rows = np.arange(a, min(own.stop, a + STEP))
        for b in range(max(a, others.start), others.stop, STEP):
            near, wide = estimate(coded.signs[rows], coded.factors[rows], coded.turned[b : min(others.stop, b + STEP)])
            i, j = np.nonzero(near + wide[:, None] >= cosine)
            i, j = rows[i], j + b
            keep = i < j
            i, j = i[keep], j[keep]
            if table and len(i):
                new = ~(key[i, :table] == key[j, :table]).any(axis=1)
                i, j = i[new], j[new]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                sure = exact(coded.raw[x], coded.raw[y]) >= cosine
                if sure.any():
                    yield x[sure], y[sure]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links is the number of other rows found with a cosine of at least cosine; component_id the least id that links
    reach. Equal vectors are one entry with a count. The index has tables of hyperplane keys, with more bits and tables
    as rows grow, and every entry is in all of them; a pair is judged in the first table that it meets in, so links are
    counted where they are found and never gathered. Large buckets meet by pairs of blocks. Vectors null, zero, or with null or non-finite components link
    with nothing; shorter ones are filled up with zeros; repeated rows link with each other; a null id is never a
    component_id unless all ids in it are null; an empty table gives no rows; other columns are ignored.
    """
    prepared(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(finite(v) & F.exists(v, lambda x: x != 0), v).alias("v"))
    entries = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    entries = cut(entries.withColumn("e", F.monotonically_increasing_id()))
    n, width = entries.count(), max(1, width_of(entries, "v"))
    bits, count = tables(n, cosine)
    turn, normals = rotations(width, seed=seed), planes(width, bits, count, seed)

    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"  # as floats, nothing is lost
    kind, key_kind = np.float32 if single else np.float64, np.uint16 if bits <= 16 else np.int64

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = matrix(batch["v"], width)
            found = keys(m / np.abs(m).max(axis=1, keepdims=True), normals, bits)
            yield pd.DataFrame({"e": batch["e"], "n": batch["n"], "raw": [x.tobytes() for x in m.astype(kind)], "keys": [x.tobytes() for x in found.astype(key_kind)], "each": list(found)})

    each = cut(entries.select("e", "n", "v").mapInPandas(keyed, "e long, n long, raw binary, keys binary, each array<long>"))
    # The rows of a bucket that is larger than a block meet by pairs of blocks, a task a pair.
    large = cut(each.select(F.posexplode("each").alias("t", "b")).groupBy("t", "b").count().where(F.col("count") > SPLIT).select("t", "b", F.ceil(F.col("count") / SPLIT).cast("int").alias("blocks")))
    dealt = each.select("e", "n", "raw", "keys", F.posexplode("each").alias("t", "b"))
    if (some := large.count()):
        dealt = dealt.join(F.broadcast(large) if some <= FEW else large, ["t", "b"], "left").withColumn("block", F.pmod(F.xxhash64("e"), F.coalesce("blocks", F.lit(1))).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    else:
        dealt = dealt.select("*", *(F.lit(0).alias(c) for c in ("block", "one", "two")))
    dealt = dealt.select("t", "b", "one", "two", "block", "e", "n", "raw", "keys")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole(batches, ["t", "b", "one", "two"], 4 * STEP):
            group = part[["t", "b", "one", "two"]].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
            size = np.diff(np.append(first, len(part)))
            several = np.repeat(size > 1, size)
            part, group = part[several], group[several]
            first = np.cumsum(size[size > 1]) - size[size > 1]
            if not len(part):
                continue
            coded = Coded(np.frombuffer(b"".join(part["raw"]), kind).reshape(len(part), width).astype(np.float64), turn)
            key = np.frombuffer(b"".join(part["keys"]), key_kind).reshape(len(part), count)
            mass, e, block = part["n"].to_numpy(), part["e"].to_numpy(), part["block"].to_numpy()
            more, forest = np.zeros(len(part), np.int64), Forest(len(part))
            for a, z in zip(first, [*first[1:], len(part)], strict=True):
                table, _, one, two = group[a]
                split = a + int((block[a:z] == one).sum())
                own, others = (range(a, z), range(a, z)) if one == two else (range(a, split), range(split, z))
                for i, j in linked(coded, key, int(table), cosine, own, others):
                    np.add.at(more, i, mass[j])
                    np.add.at(more, j, mass[i])
                    forest.link(i, j)
            got = np.flatnonzero(more)
            if len(got):
                yield pd.DataFrame({"u": e[got], "v": e[forest.root[got]], "more": more[got]})

    ordered = dealt.repartition(partitions(dealt), "t", "b", "one", "two").sortWithinPartitions("t", "b", "one", "two", "block")
    found = cut(ordered.mapInPandas(met, "u long, v long, more long"))
    more = found.groupBy(F.col("u").alias("e")).agg(F.sum("more").alias("more"))
    # An entry's node begins with its least id, so the least node of a component says the component's id.
    nodes = entries.select("e", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("e").alias("e")).alias("node"))
    ends = [nodes.select(F.col("e").alias(end), F.col("node").alias(f"{end}_node")) for end in "uv"]
    edges = found.where("u <> v").select("u", "v").distinct().join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    root = components(edges).select(F.col("node.e").alias("e"), F.col("component.id").alias("component_id"))
    of = entries.join(more, "e", "left").join(root, "e", "left")
    named = of.select("v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(named, "v", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
