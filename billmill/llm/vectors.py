"""Vectors as packed blocks: cleaning, norms, and the Gram matrix that a rotation is made from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(vectors: pd.Series, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of one width; shorter vectors are filled up with zeros."""
    if all(len(v) == width for v in vectors):
        return np.array(vectors.tolist(), kind).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def width_of(vectors: DataFrame, column: str) -> int:
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def gram(vectors: DataFrame, column: str, width: int) -> np.ndarray:
    """Sum of the outer products of all rows: each task sends one matrix of width x width, whatever its rows."""

    def summed(batches):
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            m, seen = matrix(batch[column], width), True
            total += m.T @ m
        if seen:
            yield pd.DataFrame({"i": np.arange(width), "g": list(total)})

    parts = vectors.select(column).mapInPandas(summed, "i int, g array<double>")
    each = parts.select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((width, width))
    for r in each:
        out[r["i"], r["j"]] = r["x"]
    return out
