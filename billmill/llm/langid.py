"""Language identification: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest ridge regression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared

#: n-grams of 1 to ORDERS code points; each has one of WIDTH places by its hash.
ORDERS, WIDTH = 3, 1 << 13
#: The model's training sample: about this many rows a language (all, where there are fewer); and how many are landmarks.
SAMPLE, LANDMARKS = 500, 128
RIDGE, SEED = 1e-3, 42
#: No prediction: no text, or no letter in it.
UNKNOWN = "und"
#: Where a claim can be asked for: different n-grams of a text that is judged by it (some 40 letters).
EVIDENCE = 100
#: Labels that a model may have: the driver and the broadcast hold LANDMARKS rows or twice the labels, and SAMPLE bits each.
MOST_LABELS = 1000
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def presence(text: str) -> np.ndarray:
    """One byte a place: 1 where an n-gram of the lower-cased text falls. Digits and runs of white space are one sign."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    codes = np.where((codes >= 48) & (codes < 58), np.uint32(48), codes)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes = np.where(blank, np.uint32(32), codes)[~(blank & np.concatenate([[False], blank[:-1]]))]
    out = np.zeros(WIDTH, np.uint8)
    sums = np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        if n:
            sums = sums[:-1]
        if not len(sums):
            break
        sums = (sums ^ codes[n:]) * MULTIPLIERS[n]
        sums ^= sums >> np.uint32(15)
        out[(sums * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 13)] = 1
    return out


@dataclass
class Model:
    """Classes; landmarks' presence rows, of unit length; weights of the kernel values, an offset in the last row."""

    labels: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """One-versus-rest scores of presence rows: two matrix products for a whole batch."""
        x = rows.astype(np.float32)
        x /= np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.int64)))[:, None].astype(np.float32)
        return (x @ self.landmarks.T) @ self.weights[:-1] + self.weights[-1]


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Ridge regression on Nyström features; rows: presence, in an order that doesn't depend on how data are parted."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((0, WIDTH), np.float32), np.zeros((1, 0), np.float32))
    x = rows / np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.int64)))[:, None]
    of = np.array([names.index(label) for label in labels])
    turn = np.zeros(len(of), int)  # each language has its share of the landmarks
    for c in range(len(names)):
        turn[of == c] = np.arange((of == c).sum())
    marks = x[np.lexsort((of, turn))[: max(landmarks, 2 * len(names))]]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    root = vectors / np.sqrt(np.maximum(values, 1e-9)) * (values > 1e-9)
    features = (x @ marks.T) @ root
    mean, target = features.mean(axis=0), np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(of)[of]
    weight = weight / weight.sum()
    centre = weight @ features
    f, y = features - centre, target - weight @ target
    solved = np.linalg.solve(f.T @ (weight[:, None] * f) + ridge / len(mean) * np.eye(len(mean)), f.T @ (weight[:, None] * y))
    return Model(names, marks.astype(np.float32), np.vstack([root @ solved, weight @ target - centre @ solved]).astype(np.float32))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most_labels: int = MOST_LABELS) -> Model:
    """A model of the rows that have text and language and aren't held out.

    Of each language, rows whose hashed id is below sample / (the language's rows) are taken: about sample rows, which
    is the bound on what the driver gets, as WIDTH bits each. More than most_labels different labels are an error.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).count().take(most_labels + 1)}
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels in {lang_col}: give most_labels if they are languages")
    if not counts:
        return fit(np.zeros((0, WIDTH), np.uint8), [])
    share = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, sample / n)))[F.col(lang_col)]
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "bits": [np.packbits(presence(t)).tobytes() for t in batch["text"]]})

    chosen = labelled.where(place < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = sorted((r["lang"], bytes(r["bits"])) for r in chosen.mapInPandas(packed, "lang string, bits binary").collect())
    rng = np.random.default_rng(SEED)
    got = [got[i] for i in rng.permutation(len(got))]
    rows = np.array([np.unpackbits(np.frombuffer(bits, np.uint8)) for _, bits in got], np.uint8).reshape(-1, WIDTH)
    return fit(rows, [lang for lang, _ in got])


def predicted(texts: list[str | None], model: Model, claim: float | None = None) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1, a softmax of the class scores) of each text; a text is read whole. With a claim, a
    text of EVIDENCE n-grams or more in which no class scores above the claim is UNKNOWN."""
    some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.labels else []
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for at in range(0, len(some), 256):
        part = some[at : at + 256]
        rows = np.array([presence(texts[i]) for i in part])
        raw = model.scores(rows)
        known = np.full(len(part), True) if claim is None else (raw.max(axis=1) > claim) | (rows.sum(axis=1, dtype=np.int64) < EVIDENCE)
        found = 4 * raw
        odds = np.exp(found - found.max(axis=1, keepdims=True))
        scores[part] = np.where(known, (odds / odds.sum(axis=1, keepdims=True)).max(axis=1), 0.0)
        for i, c, k in zip(part, found.argmax(axis=1), known, strict=True):
            if k:
                names[i] = model.labels[c]
    return names, scores


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", claim: float | None = None) -> DataFrame:
    """docs with pred_col and score_col, which replace columns of those names. Only the text is looked at.

    A null text, or one without a letter, gets UNKNOWN and score 0, as does every text where the model has learned no
    language. With a claim, so does a text that no class claims: a class's score goes from -1 to 1, and is above 0 where
    its one-versus-rest decision is a yes. Rows keep all other columns; repeated rows come back repeated; an empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.labels, model.landmarks, model.weights))
    names = [c for c in docs.columns if c not in (pred_col, score_col)]

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Model(*shared.value)
        for batch in batches:
            lang, score = predicted(batch["text"].tolist(), known, claim)
            yield pd.DataFrame({"row": batch["row"], "text": batch["text"], "lang": lang, "score": score})

    others = F.struct(F.lit(0), *(F.col(f"`{c}`") for c in names if c != text_col)).alias("row")
    kind = docs.select(others).schema["row"].dataType.simpleString()
    out = docs.select(others, F.col(text_col).alias("text")).mapInPandas(named, f"row {kind}, text string, lang string, score double")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names), F.col("lang").alias(pred_col), F.col("score").alias(score_col))
