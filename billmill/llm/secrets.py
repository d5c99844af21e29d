"""Secret scans: fixed patterns, and windows of high Shannon entropy within a character class."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared

#: Fixed patterns. In a name, letters of either case count, ASCII only. A match that fails its length is dropped whole.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Strings that entropy is measured in: unbroken runs of base64 and URL-safe letters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class, its letters, window length and least bits a letter; the first class that has all letters of a string counts.
CLASSES = (("digits", re.compile(r"[0-9]+"), 20, 2.6), ("hex", re.compile(r"[0-9a-fA-F]+"), 32, 3.3), ("alnum", re.compile(r"[A-Za-z0-9]+"), 24, 4.1), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 4.1))
#: Benign strings: identifiers in UUID form, runs of letters without a digit (words), paths and hyphenated words.
ALLOWED = re.compile(r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})|[A-Za-z=]+|[A-Za-z]*(?:[-_/][A-Za-z]*)*[0-9]{0,4}=*")

#: Words that are joined by capitals, and how many letters they have on average at least: letters of random case make
#: pieces of 2.7 (1 in 20 strings reaches 3.6 at 24 letters), identifiers of 4 and more.
PIECES, PIECE = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), 3.6


def benign(word: str) -> bool:
    """On the allow-list, and its capitals, if there are any, begin words. Words of one case are benign, whatever they say."""
    if not ALLOWED.fullmatch(word):
        return False
    plain = word.islower() or word.isupper() or any(c in word for c in "-_/")
    return plain or sum(map(str.isalpha, word)) >= PIECE * len(PIECES.findall(word))


def hot_windows(text: str, width: int, least: float) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of width letters with entropy of least bits or more.

    Counts are kept as the window slides: a letter that comes or goes changes one term of sum(n log n).
    """
    term = [n * math.log2(n) if n else 0.0 for n in range(width + 2)]
    counts: dict[str, int] = {}
    total, most, out = 0.0, (math.log2(width) - least) * width + 1e-9, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= width:
            gone = text[i - width]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
        if i >= width - 1 and total <= most:
            start = i - width + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(text: str, short: bool = False) -> list[tuple[int, int]]:
    """Hot windows of the candidate strings that no allow-list rule covers. With short, a string shorter than its
    class's window is one window, and the least bits fall with the logarithm of its length."""
    out = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if benign(word):
            continue
        _, _, width, least = next(c for c in CLASSES if c[1].fullmatch(word))
        if short and len(word) < width:
            width, least = len(word), least * math.log2(len(word)) / math.log2(width)
        if len(set(word)) >= 2**least - 1e-9:
            out += [(m.start() + a, m.start() + b) for a, b in hot_windows(word, width, least)]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by the fixed patterns alone."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """text with each run of overlapping spans replaced by mask."""
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str | None = None, short: bool = False) -> DataFrame:
    """One row a document: the id, n_assign, n_access, n_hex, n_entropy, base_spans, spans, and with a mask also clean.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas; base_spans has
    those of the fixed patterns; short is that of entropy_spans(). clean is the text with what the spans cover masked (null stays null). A null text is
    scanned as empty; repeated rows come back repeated; an empty table gives no rows; other columns are ignored.
    """
    prepared(docs.sparkSession)

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text or "")
                all_ = sorted(base + [(a, 3, b) for a, b in entropy_spans(text or "", short)])
                n = [sum(k == kind for _, k, _ in all_) for kind in range(4)]
                rows.append((*n, spelled(base), spelled(all_), *([text and redacted(text, all_, mask)] if mask is not None else [])))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_entropy", "base_spans", "spans", *["clean"] * (mask is not None)], index=batch.index)
            yield pd.concat([batch[["id"]], out], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_spans string, spans string" + ", clean string" * (mask is not None)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(scanned, columns).withColumnRenamed("id", id_col)


def without_secrets(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text", short: bool = False) -> DataFrame:
    """docs with secrets in the text masked; every row and every other column stays."""
    prepared(docs.sparkSession)
    names = docs.columns

    def masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t and redacted(t, sorted(base_spans(t) + [(a, 3, b) for a, b in entropy_spans(t, short)]), mask) for t in batch["text"]]
            yield pd.DataFrame({"row": batch["row"], "text": texts})

    if names == [text_col]:
        return docs.select(F.lit(0).alias("row"), F.col(text_col).alias("text")).mapInPandas(masked, "row int, text string").select(F.col("text").alias(text_col))
    others = F.struct(*(F.col(f"`{c}`") for c in names if c != text_col)).alias("row")
    kind = docs.select(others).schema["row"].dataType.simpleString()
    out = docs.select(others, F.col(text_col).alias("text")).mapInPandas(masked, f"row {kind}, text string")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
