"""Substring deduplication: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

A symbol is a block of SYMBOL bytes, and a region of text is read as SYMBOL strings, one for each phase, so that every
byte starts a suffix. Each shard of regions sorts its own suffixes once and keeps its transform: the symbol before each
suffix, in suffix order. Merging never looks at suffixes again (Holt and McMillan, 2014): the interleave, which says
from which shard the next suffix comes, is refined one symbol a round by one stable pass over the transforms' symbols.
The round that parts a suffix from the one before it is their common prefix; where length / SYMBOL rounds do not, the
prefix is long enough, and runs of such suffixes are the repeated intervals.

Regions are the contexts of anchors that occur more than once (see anchors), each distinct one once with the number of
its places, so what goes through this is all that may repeat, what repeats is told by the intervals alone, and equal
strings of length bytes are always merged in one task. A symbol stands for 50 bytes by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .anchors import Rolled, byte_symbols, covered, runs, with_spans
from .common import prepared

LENGTH, ANCHOR, SYMBOL = 200, 32, 50
#: Bytes of regions that are merged at a time (whole anchors), and suffixes of a shard: few enough for a core's cache.
MERGED, SHARD = 100_000, 1 << 15


def narrow(values: np.ndarray, most: int) -> np.ndarray:
    """values, none above most, in as few bytes as a radix sort can take them, if it can."""
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16) if most < 1 << 16 else values


def by_symbol(symbols: np.ndarray, most: int) -> np.ndarray:
    """A stable order by symbol (most at most, below 2^32), 16 bits a pass."""
    if most <= 0xFFFF:
        return np.argsort(narrow(symbols, most), kind="stable")
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort(narrow(symbols >> 16, most >> 16)[order], kind="stable")]


class Shard:
    """Suffixes of regions: positions 0 to n - 1 with a symbol each (from 1), then the strings' ends."""

    def __init__(self, sizes: np.ndarray, symbols: np.ndarray, step: int):
        n, base = len(symbols), np.cumsum(sizes) - sizes
        strings = np.minimum(sizes, step)  # a phase each
        self.symbols, self.ends = symbols, int(strings.sum())
        phase = np.arange(self.ends) - np.repeat(np.cumsum(strings) - strings, strings)
        before = np.arange(-step, n + self.ends - step, dtype=np.int32)
        before[np.repeat(base, strings) + phase] = -1
        before[n:] = np.repeat(base + sizes - strings, strings) + phase
        self.before = np.append(symbols, 0)[before]  # 0: the string starts here
        here = np.flatnonzero(np.bincount(self.before, minlength=1))
        rank = np.zeros(here[-1] + 1 if len(here) else 1, np.int32)  # this shard's symbols only, so that a pass does
        rank[here] = np.arange(len(here))
        own = narrow(rank[self.before], len(here))
        first = np.arange(n, n + self.ends, dtype=np.int32)
        order = np.concatenate([first, np.arange(n, dtype=np.int32)])
        for _ in range(-(-int(sizes.max(initial=0)) // step) + 1):
            order = before[order[by_symbol(own[order], len(here))]]
            order[: self.ends] = first  # in the places of the starts, which nothing is before
        self.order, self.bwt = order, self.before[order]


def interleaved(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, lcp) of each suffix in merged order by the first `rounds` symbols; lcp: symbols in common with the suffix
    before, as far as rounds tell."""
    each = narrow(np.arange(len(shards)), len(shards))
    ends = np.repeat(each, [s.ends for s in shards])
    of, bwt = np.repeat(each, [len(s.order) for s in shards]), np.concatenate([s.bwt for s in shards])
    most = int(bwt.max(initial=0))
    bwt = narrow(bwt, most)
    block, lcp = np.zeros(len(of), np.int32), np.full(len(of), rounds, np.int32)
    differs, symbols = np.ones(len(of), bool), np.empty_like(bwt)
    for done in range(rounds):
        symbols[np.argsort(of, kind="stable")] = bwt  # each shard's, in its own order
        order = by_symbol(symbols, most)  # strings' starts come first, and make room for the ends
        of, s, b = of[order], symbols[order], block[order]
        of[: len(ends)] = ends
        differs[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        differs[: len(ends) + 1] = True
        block = np.cumsum(differs, dtype=np.int32)
        lcp[differs & (lcp == rounds)] = done
    return of, lcp


def repeated(regions: list[bytes], counts: np.ndarray, length: int = LENGTH, step: int = SYMBOL) -> list[np.ndarray]:
    """For each region, which of its length-byte strings also start elsewhere; counts: how often there is the region."""
    whole = np.array([len(r) for r in regions])
    sizes, base = whole - step + 1, np.cumsum(whole) - whole
    first = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    at = inside + np.repeat(base, sizes)
    hashed = Rolled(byte_symbols(b"".join(regions))).runs(at, at + step)
    symbols = (np.unique(hashed, return_inverse=True)[1] + 1).astype(np.int32)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SHARD)) + 1), len(regions)]
    cuts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    shards = [Shard(sizes[a:b], symbols[first[a] : first[b]], step) for a, b in cuts]
    of, lcp = interleaved(shards, length // step)
    position = np.empty(len(of), np.int64)  # of each merged suffix; the ends have the last place
    position[np.argsort(of, kind="stable")] = np.concatenate([np.where(s.order < len(s.symbols), s.order + first[a], first[-1]) for s, (a, _) in zip(shards, cuts, strict=True)])
    full = inside < np.repeat(sizes - (length - step), sizes)
    times = np.append(np.where(full, np.repeat(counts, sizes), 0), 0)
    interval = np.cumsum(lcp < length // step) - 1
    weight = np.bincount(interval, times[position])
    out = np.zeros(first[-1] + 1, bool)
    out[position] = weight[interval] >= 2
    return [out[a : a + n] for a, n in zip(first[:-1], sizes - (length - step), strict=True)]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every document: each byte covered by a length-byte string that also
    starts anywhere else, in this or another document, is removed; kept has the others, as binary.

    Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input. A null text counts as
    empty; texts below length bytes stay whole; repeated rows of length bytes or more are removed whole, all of them;
    an empty table gives no rows; other columns are ignored.
    """
    if length % 4 or length < ANCHOR + 8:
        raise ValueError("length has to be a multiple of 4, and 40 at least")
    prepared(docs.sparkSession)

    def region(text: str, cuts: list[tuple[int, int]]) -> list[bytes]:
        raw = text.encode()
        return [raw[a : a + n] for a, n in cuts]

    def merge(part: pd.DataFrame) -> list[tuple]:
        found = repeated(part["raw"].tolist(), part["count"].to_numpy(), length, length // 4)
        return [(c, s, a, n) for c, s, flags in zip(part["ctx"], part["share"], found, strict=True) for a, n in runs(flags)]

    judged = with_spans(docs, id_col, text_col, lambda t: byte_symbols((t or "").encode()), region, merge, MERGED, length, ANCHOR)

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                gone = covered(len(raw), length, spans)
                out.append((len(raw), int(gone.sum()), len(runs(gone)), raw[~gone].tobytes()))
            yield pd.concat([batch[["id"]], pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"], index=batch.index)], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    return judged.mapInPandas(removed, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
