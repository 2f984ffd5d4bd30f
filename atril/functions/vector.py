"""Vector functions (survey ids F10, P10, C9 default embedder)."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


@lru_cache(maxsize=200_000)
def _slot(word: str, dim: int) -> tuple[int, float]:
    h = int(hashlib.md5(word.encode()).hexdigest()[:6], 16)
    return h % dim, 1.0 if (h // dim) % 2 == 0 else -1.0


def hashed_embedder(texts: list[str], dim: int = 64) -> list[np.ndarray]:
    """Deterministic offline stand-in for an embedding model: every distinct word adds
    +1 or -1 to one of `dim` slots (both from its md5); the sum is length-normalised."""
    out = []
    for text in texts:
        v = np.zeros(dim)
        for word in set(re.findall(r"\w+", (text or "").lower())):
            slot, sign = _slot(word, dim)
            v[slot] += sign
        length = np.sqrt((v * v).sum())
        out.append((v / length if length else v).astype(np.float32))
    return out
