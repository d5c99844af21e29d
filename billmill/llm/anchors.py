"""Repeated windows of a long corpus: content-defined anchors bring equal windows to one place.

A window is `length` consecutive symbols (bytes or words) of one document. Of the k-symbol runs inside a window, the
one with the least hash (the leftmost of these) is its anchor, so equal windows have equal anchors at equal places.
Neighbouring windows mostly share an anchor: an anchor with the windows that it owns is a *context*, and about one in
(length - k) / 2 symbols is an anchor. Windows can repeat only where anchors do, which tells most of a corpus apart
without looking at its windows. Equal contexts are one row with a count and the places where they are, so what
judges windows sees each distinct context once, and its verdict goes to all of its places.

Text that very many documents share, with something else around it in each, makes contexts that differ but have one
anchor. For such anchors, which a look at some documents finds, each window is a context of its own and has its own
hash for an anchor, so that they are dealt to all tasks. Contexts of such anchors with copies nearby are dealt whole, by
their own hashes, so that copies have a place a context and not one a window; their windows are counted beside that.
This tells only how windows are dealt, not which repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, whole

U = np.uint64
BASE = 0x9E3779B97F4A7C15
LAYOUT = "anchor long, ctx long, uid binary, lo long, n long, m long, members binary"
SIFTED = "anchor long, ctx long, uid binary, lo long, n long, m long, members binary, kind long, share long, count long"
ASKED = "anchor long, ctx long, n long, share long, count long, raw binary"
#: Where one context of a part is.
MEMBER = np.dtype([("uid", "V16"), ("lo", "<i4")])
#: Rows of a context in one share of its places.
SHARE = 4096
#: Documents that anchors with very many differing contexts are looked for in, and how many contexts are very many.
LOOKED_AT, MANY = 20_000, 64
#: Symbols worked on at a time, and the bits that tell their places apart.
PART, PLACE = 1 << 20, 22


POWERS: dict[int, list[np.ndarray]] = {}


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers 0 to n - 1; made once a worker."""
    if n not in POWERS:
        with np.errstate(over="ignore"):
            POWERS[n] = [np.concatenate([[U(1)], np.full(n - 1, U(b), U)]).cumprod(dtype=U) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return POWERS[n]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


class Rolled:
    """Hashes of any run of symbols from one pass of prefix sums."""

    def __init__(self, symbols: np.ndarray):
        self.up, self.down = (p[: len(symbols) + 1] for p in powers(max(2 * PART + 2, 1 << len(symbols).bit_length())))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[U(0)], np.cumsum(symbols * self.up[:-1], dtype=U)])

    def runs(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start])


BYTES = mixed(np.arange(1, 257, dtype=U) * U(BASE & 0xFFFFFFFF))


def byte_symbols(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, np.uint8)]


def word_symbols(words: list[bytes]) -> np.ndarray:
    """A hash of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, by running minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def owners(grams: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each run of width grams is, the leftmost of equals."""
    mask = U((1 << PLACE) - 1)
    return (least_of((grams & ~mask) | np.arange(len(grams), dtype=U), width) & mask).astype(np.int64)


def contexts(parts: list[tuple[bytes, int, np.ndarray]], length: int, k: int, busy: np.ndarray | None = None) -> pd.DataFrame:
    """The distinct contexts in parts, which are (uid, place of the first symbol, symbols).

    anchor, ctx: hashes of the anchor and of all the context's symbols and its shape; lo: where its first window
    starts in document uid; n: its windows; m: how often it is in these parts. If m > 1, all its places come in a row
    of their own, as members, with m = 0. So a context with any number of copies is a short row a part to those who
    look for more copies. busy: anchors whose windows are contexts of their own; but a context that these parts have
    more than once stays whole, with its own hash for an anchor, and its windows go along once, with its m and without
    places, for others to be counted with.
    """
    parts = [p for p in parts if len(p[2]) >= length]
    if not parts:
        return pd.DataFrame({c: pd.Series(dtype=object if c in ("uid", "members") else "int64") for c in ("anchor", "ctx", "uid", "lo", "n", "m", "members")})
    symbols = np.concatenate([p[2] for p in parts])
    sizes = np.array([len(p[2]) for p in parts])
    ends = np.cumsum(sizes)
    rolled = Rolled(symbols)
    grams = rolled.runs(slice(0, len(symbols) - k + 1), slice(k, len(symbols) + 1))
    owner = owners(grams, length - k + 1)
    of = np.repeat(np.arange(len(parts)), sizes)[: len(owner)]
    valid = np.arange(len(owner)) + length <= ends[of]
    change = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (of[1:] != of[:-1]) | (valid[1:] != valid[:-1])]))
    n = np.diff(np.append(change, len(owner)))
    lo, n = change[valid[change]], n[valid[change]]

    def hashed(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(rolled.runs(lo, lo + n - 1 + length) ^ (n.astype(U) << U(32)) ^ (owner[lo] - lo).astype(U))

    anchor, ctx, times = grams[owner[lo]], hashed(lo, n), np.ones(len(lo), np.int64)
    if busy is not None and len(busy):
        hot = np.flatnonzero(np.isin(anchor, busy))
        first, which, m = np.unique(ctx[hot], return_index=True, return_inverse=True, return_counts=True)[1:]
        copied = (m[which] > 1) & (n[hot] > 1)
        anchor[hot[copied]] = mixed(ctx[hot[copied]])
        once = ~copied | (first[which] == np.arange(len(hot)))  # the windows of copies are counted, but have no places
        size = n[hot[once]]
        alone = np.repeat(lo[hot[once]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        stays = np.delete(np.arange(len(lo)), hot[~copied])
        lo, n, times = np.concatenate([lo[stays], alone]), np.concatenate([n[stays], np.ones(len(alone), n.dtype)]), np.concatenate([times[stays], np.repeat(np.where(copied, m[which], 1)[once], size)])
        anchor, ctx = np.concatenate([anchor[stays], mixed(rolled.runs(alone, alone + length))]), np.concatenate([ctx[stays], hashed(alone, n[len(stays) :])])
    doc = of[lo]
    which, rows = np.unique(ctx, return_inverse=True, return_counts=True)[1:]
    m = np.bincount(which, times, len(rows)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    one = order[np.cumsum(rows) - rows]
    placed = order[times[order] == 1]
    c = np.bincount(which[placed], minlength=len(rows))
    places = np.empty(len(ctx), MEMBER)
    places["uid"] = np.frombuffer(b"".join([p[0] for p in parts]), "V16")[doc]
    places["lo"] = lo - (ends - sizes)[doc] + np.array([p[1] for p in parts], np.int64)[doc]
    out = pd.DataFrame({"anchor": anchor[one].view(np.int64), "ctx": ctx[one].view(np.int64), "uid": places["uid"][one].tolist(), "lo": places["lo"][one].astype(np.int64), "n": n[one], "m": m, "members": None})
    raw, size, last, more = places[placed].tobytes(), MEMBER.itemsize, np.cumsum(c), (m > 1) & (c > 0)
    several = out[more].assign(m=0, members=[raw[(e - k) * size : e * size] for e, k in zip(last[more].tolist(), c[more].tolist(), strict=True)])
    return pd.concat([out, several], ignore_index=True)


def parted(docs: Iterator[tuple[bytes, np.ndarray]], length: int) -> Iterator[list[tuple[bytes, int, np.ndarray]]]:
    """Documents gathered to about PART symbols; a longer one is cut so that each window is in one part."""
    held, size = [], 0
    for uid, symbols in docs:
        for at in range(0, max(1, len(symbols) - length + 1), PART):
            part = symbols[at : at + PART + length - 1]
            if held and size + len(part) > 2 * PART:
                yield held
                held, size = [], 0
            held.append((uid, at, part))
            size += len(part)
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


class Sift:
    """Contexts sorted by anchor and ctx, in batches; leaves out those whose anchor is nowhere else.

    Kinds on the way out. 0: places of a context that has several. Rows with m = 1 are numbered within the context,
    and `share` tells which SHARE of them one is in; those with members pass through, as share 0. 1: a distinct context, for its windows to be judged, with the count of its places (if one, this row is
    its place) and its last share. What is kept between batches is one row of either kind.
    """

    def __init__(self):
        self.last, self.held = None, None
        self.key, self.again = None, None
        self.rows, self.total = 0, 0

    def batch(self, new: pd.DataFrame, end: bool = False) -> pd.DataFrame:
        passing = new[new["m"] == 0].assign(kind=0, share=0, count=0)
        new = new[new["m"] > 0]
        rows = new if self.last is None else pd.concat([self.last, new], ignore_index=True)
        n = len(rows) - (not end)
        if n < 0:
            return passing[[*SIFTED_COLUMNS]]
        a, c, m = (rows[x].to_numpy(np.int64) for x in ("anchor", "ctx", "m"))
        differs = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        start = np.concatenate([[len(a) > 0 and self.key != (a[0], c[0])], differs])[:n]
        last = np.append(differs, True)[:n]
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(start, at, -1)) if n else at
        row = np.where(first >= 0, at - first, at + self.rows)
        total = np.cumsum(m[:n])
        total = np.where(first >= 0, total - (total - m[:n])[first], total + self.total) if n else total
        head = rows.iloc[:n].assign(share=row // SHARE, count=total)
        places = head[(~start | ~last) & (m[:n] == 1)].assign(kind=0)
        self.last = rows.iloc[n:]
        if n:
            self.key, self.rows, self.total = (a[n - 1], c[n - 1]), row[-1] + 1, total[-1]
        return pd.concat([passing, places, self.asked(head[last], None if end else a[n], end)], ignore_index=True)[[*SIFTED_COLUMNS]]

    def asked(self, new: pd.DataFrame | None, next_anchor: int | None, end: bool) -> pd.DataFrame:
        parts = [x for x in (self.held, new) if x is not None and len(x)]
        if not parts:
            return pd.DataFrame({x: pd.Series(dtype=object if x in ("uid", "members") else "int64") for x in SIFTED_COLUMNS})
        all_ = pd.concat(parts, ignore_index=True)
        a = all_["anchor"].to_numpy()
        alone = (all_.groupby("anchor")["anchor"].transform("size").to_numpy() == 1) & (all_["count"].to_numpy() == 1) & (a != (a[0] - 1 if self.again is None else self.again))
        going = np.zeros(len(a), bool) if end else a == next_anchor
        self.held = all_[going & alone]
        if not alone[-1]:
            self.again = a[-1]
        return all_.assign(kind=1, members=None)[~alone]


SIFTED_COLUMNS = tuple(x.split()[0] for x in SIFTED.split(", "))


def gathered(batches: Iterator[pd.DataFrame], rows: int = 1 << 13) -> Iterator[pd.DataFrame]:
    """Batches of short rows, some of them at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def sifted(found: DataFrame) -> DataFrame:
    """Contexts with their kind (see Sift). Rows of an anchor meet in one task, which streams them, whatever their number;
    those with members are dealt by themselves."""

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, empty = Sift(), None
        for batch in gathered(batches):
            empty = batch.iloc[:0]
            yield state.batch(batch)
        if empty is not None:
            yield state.batch(empty, end=True)

    key = F.when(F.col("m") > 0, F.col("anchor")).otherwise(F.xxhash64("uid", "lo"))
    return found.repartition(partitions(found), key).sortWithinPartitions("anchor", "ctx", "uid", "lo").mapInPandas(sift, SIFTED)


def busy_anchors(rows: DataFrame, symbols: Callable[[str | None], np.ndarray], length: int, k: int) -> np.ndarray:
    """Anchors with MANY differing contexts or more in about LOOKED_AT rows: at most a MANY-th of the contexts there."""
    share = LOOKED_AT / max(1, rows.count())
    some = rows.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 40)) < int(share * (1 << 40)))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parted(((uid, symbols(text)) for uid, text in zip(batch["uid"], batch["text"], strict=True)), length):
                yield contexts(part, length, k)[["anchor", "ctx"]]

    each = some.select("uid", "text").mapInPandas(find, "anchor long, ctx long").distinct()
    return np.array([r["anchor"] for r in each.groupBy("anchor").count().where(F.col("count") >= MANY).collect()], np.int64).view(U)


def with_spans(docs: DataFrame, id_col: str, text_col: str, symbols: Callable[[str | None], np.ndarray], region: Callable[[str, list], list[bytes]], judge: Callable[[pd.DataFrame], list[tuple]], most: int, length: int, k: int) -> DataFrame:
    """(uid, id, text, spans) of every document: spans are the windows (lo, n) that judge says repeat.

    region cuts the bytes of symbols (start, number) out of a text. judge gets all distinct contexts of some anchors as
    rows (anchor, ctx, n, share, count, raw): raw has n windows, and count is how
    often the context is in the documents; it returns (ctx, share, lo, n), runs of windows within a context. Verdicts
    go to places by share. A document's uid is a hash of its id and text, 128 bits, so that rows of a lost executor
    get theirs again; rows that are equal in both have one uid, are counted each, and get the same spans.
    """
    number = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(id_col).isNull(), id_col, text_col)), 16, "0")
    rows = docs.select(F.unhex(F.concat(number(1), number(2))).alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    busy = busy_anchors(rows, symbols, length, k)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parted(((uid, symbols(text)) for uid, text in zip(batch["uid"], batch["text"], strict=True)), length):
                yield contexts(part, length, k, busy)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, ask in zip(batch["text"], batch["ask"], strict=True):
                raws = region(text, [(x["lo"], x["n"] - 1 + length) for x in ask])
                out += [(x["anchor"], x["ctx"], x["n"], x["share"], x["count"], raw) for x, raw in zip(ask, raws, strict=True)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ASKED.split(", ")])

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole((b.assign(size=b["raw"].str.len()) for b in batches), ["anchor"], most, "size"):
            yield pd.DataFrame(judge(part), columns=["ctx", "share", "at", "runs"], dtype="int64")

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in gathered(batches):
            several = batch["members"].notna().to_numpy()
            raw = batch["members"][several]
            places = np.frombuffer(b"".join(raw), MEMBER)
            times = (raw.str.len() // MEMBER.itemsize).to_numpy(np.int64)
            rest, at, n = batch[~several], batch["at"].to_numpy(), batch["runs"].to_numpy()
            lo = np.concatenate([rest["lo"].to_numpy() + at[~several], places["lo"] + np.repeat(at[several], times)])
            yield pd.DataFrame({"uid": [*rest["uid"], *places["uid"].tolist()], "lo": lo, "n": np.concatenate([n[~several], np.repeat(n[several], times)])})

    parts = partitions(docs)
    known = stored(sifted(rows.mapInPandas(find, LAYOUT)), "contexts")
    asks = known.where("kind = 1").groupBy("uid").agg(F.collect_list(F.struct("anchor", "ctx", "lo", "n", "share", "count")).alias("ask"))
    asked = rows.join(asks.hint("shuffle_hash"), "uid").mapInPandas(fetch, ASKED)
    verdicts = asked.repartition(parts, "anchor").sortWithinPartitions("anchor", "ctx").mapInPandas(judged, "ctx long, share long, at long, runs long")
    verdicts = verdicts.select("ctx", F.explode(F.sequence(F.lit(0).cast("long"), "share")).alias("share"), "at", "runs")
    places = known.where("kind = 0 or count = 1").select("ctx", "share", "uid", "lo", "members")
    spans = places.join(verdicts.hint("shuffle_hash"), ["ctx", "share"]).select("uid", "lo", "members", "at", "runs").mapInPandas(unfold, "uid binary, lo long, n long")
    lists = spans.groupBy("uid").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    return rows.join(lists.hint("shuffle_hash"), "uid", "left")


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, number) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def covered(size: int, length: int, spans: list | np.ndarray | None) -> np.ndarray:
    """Which of size symbols the windows of the spans cover."""
    edge = np.zeros(size + 1, np.int64)
    if spans is not None and len(spans):
        lo, n = np.array([x["lo"] for x in spans]), np.array([x["n"] for x in spans])
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + n - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0
