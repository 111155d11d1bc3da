"""Vector functions: similarity as column expressions, and the deterministic stub embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import fnv1a64, fnv1a64_all


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero norm or different lengths."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def stub_vector(text: str, dimension: int) -> np.ndarray:
    """A unit vector that depends on the text only: a splitmix64 stream seeded by FNV-1a, mapped to [-1, 1)."""
    return _from_hash(fnv1a64(text.encode()), dimension)


def _from_hash(hashed: int, dimension: int) -> np.ndarray:
    gamma = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = np.uint64(hashed ^ dimension) + gamma * np.arange(1, dimension + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    out = (x >> np.uint64(40)).astype(np.float64) / float(1 << 24) * 2 - 1
    size = np.linalg.norm(out)
    return out / size if size else out


def stub_embed(dimension: int):
    """A pandas UDF that embeds texts with stub_vector(); the stand-in for a model."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        hashes = fnv1a64_all([(t or "").encode() for t in texts])
        return pd.Series([_from_hash(h, dimension).astype(np.float32) for h in hashes.tolist()], texts.index)

    return embed


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors that the mask keeps, as a unit vector; zeros if it keeps none."""
    kept = tokens[mask.astype(bool)]
    if not len(kept):
        return np.zeros(tokens.shape[1])
    mean = kept.mean(0)
    size = np.linalg.norm(mean)
    return mean / size if size else mean
