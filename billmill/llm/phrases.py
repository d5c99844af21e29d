"""Repeated passages of words: confirmed once each, compiled into sharded Aho-Corasick automata, located in all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .anchors import Rolled, covered, with_spans, word_symbols
from .common import prepared

WINDOW, ANCHOR = 35, 8
#: Bytes of the regions of one shard (whole anchors): its passages make an automaton, which then reads its regions.
SHARD = 4_000_000
#: Code points below the surrogates; 0 is between regions. Words get one each, or two letters where there are too many.
POINTS = 0xD7FF


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return (text or "").encode().split()


class Stream:
    """Regions of words, as hashes of the words and as one text in which letters stand for words."""

    def __init__(self, regions: list[bytes]):
        split = [r.split() for r in regions]
        sizes = np.array([len(r) for r in split])
        self.end = np.cumsum(sizes + 1) - 1
        self.first = self.end - sizes
        known: dict[bytes, int] = {}
        ids = np.zeros(self.end[-1] + 1, np.int64)  # 0 is after each region
        inside = np.ones(len(ids), bool)
        inside[self.end] = False
        ids[inside] = [known.setdefault(w, len(known) + 1) for r in split for w in r]
        self.symbols = np.concatenate([[np.uint64(0)], word_symbols(list(known))])[ids]
        self.wide = 1 if len(known) <= POINTS else 2
        letters = ids[:, None] if self.wide == 1 else np.column_stack([-(-ids // POINTS), np.where(ids, (ids - 1) % POINTS + 1, 0)])
        self.text = letters.astype("<u4").tobytes().decode("utf-32-le")

    def confirmed(self, counts: np.ndarray, window: int) -> set[str]:
        """The distinct passages: runs of windows that the regions, each counts times, have more than once."""
        sizes = self.end - self.first - window + 1
        base = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.first - base, sizes)
        of = np.unique(Rolled(self.symbols).runs(at, at + window), return_inverse=True)[1]
        often = np.bincount(of, np.repeat(counts, sizes))[of] > 1
        starts = often & np.concatenate([[True], ~often[:-1] | (np.diff(at) > 1)])
        last = often & np.concatenate([~often[1:] | (np.diff(at) > 1), [True]])
        return {self.text[a * self.wide : (z + window) * self.wide] for a, z in zip(at[starts].tolist(), at[last].tolist(), strict=True)}

    def hits(self, passages: set[str]) -> np.ndarray:
        """(region, start, words) of every place of a passage, by an Aho-Corasick automaton that reads the text once."""
        import ahocorasick

        if not passages:
            return np.zeros((0, 3), np.int64)
        tree = ahocorasick.Automaton()
        for passage in passages:
            tree.add_word(passage, len(passage))
        tree.make_automaton()
        found = np.array([(end + 1 - n, n) for end, n in tree.iter(self.text)], np.int64)
        start, n = found[found[:, 0] % self.wide == 0].T // self.wide
        of = np.searchsorted(self.first, start, "right") - 1
        return np.column_stack([of, start - self.first[of], n])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept) of every document: each word covered by a window of that many words that also
    starts anywhere else, in this or another document, is removed; kept has the others, joined by one space.

    Windows are judged on the input. Documents go to the shards by anchors (see anchors): each distinct region whose
    anchor recurs goes once to the shard of that anchor, with its count, and no other region can hold a recurring
    passage. A shard confirms its distinct passages, compiles them into one automaton and streams all its regions
    through it; where the automaton finds a passage, in any region, all places of that region lose it, and nothing
    else is removed. A null text has no words; repeated rows of window words or more are removed whole, all of them;
    an empty table gives no rows; other columns are ignored.
    """
    if window < ANCHOR + 2:
        raise ValueError("window has to be 10 at least")
    prepared(docs.sparkSession)

    def region(text: str, cuts: list[tuple[int, int]]) -> list[bytes]:
        split = words(text)
        return [b" ".join(split[a : a + n]) for a, n in cuts]

    def locate(part: pd.DataFrame) -> list[tuple]:
        stream = Stream(part["raw"].tolist())
        of, at, n = stream.hits(stream.confirmed(part["count"].to_numpy(), window)).T
        return np.column_stack([part["ctx"].to_numpy()[of], part["share"].to_numpy()[of], at, n - window + 1])

    judged = with_spans(docs, id_col, text_col, lambda t: word_symbols(words(t)), region, locate, SHARD, window, ANCHOR)

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                split = words(text)
                kept = [split[i] for i in np.flatnonzero(~covered(len(split), window, spans))]
                out.append((len(split), len(split) - len(kept), b" ".join(kept).decode()))
            yield pd.concat([batch[["id"]], pd.DataFrame(out, columns=["n_words", "n_removed", "kept"], index=batch.index)], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    return judged.mapInPandas(removed, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
