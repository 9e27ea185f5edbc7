"""Vectors as arrays of doubles: deterministic hash embeddings, dimension rules, cosine."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384


def embed_batch(texts: list[str | None], dimension: int = DIMENSION) -> np.ndarray:
    """Characters add by place, words by their md5 (once for each word of the batch); then unit length. No text: zeros."""
    out = np.zeros((len(texts), dimension))
    place: dict[str, int] = {}
    for k, text in enumerate(texts):
        if text:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            out[k] = np.bincount(np.arange(len(points)) % dimension, (points % 997) / 997.0, dimension)
            words = text.split()
            for w in set(words).difference(place):
                place[w] = int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:4], "big") % dimension
            out[k] += np.bincount(np.array([place[w] for w in words], np.int64), minlength=dimension)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed_batch(texts.tolist(), dimension)))

    return run(text)


def fitted(vector: Column, dimension: int = DIMENSION, on_mismatch: str = "pad") -> Column:
    """A vector of ``dimension`` values: padded with zeros or cut, or an error where ``on_mismatch`` is 'error'."""
    v = F.transform(vector, lambda x: x.cast("double"))
    if on_mismatch == "error":
        return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(F.concat(F.lit(f"vector size isn't {dimension}: "), F.size(v).cast("string"))))
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dimension)), 1, dimension)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def overlap_score(query: Column, content: Column) -> Column:
    """The part of the query's tokens (arrays of distinct ones) that the content has."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, content)) / F.size(query)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
