"""Text vectors and nearest neighbours by cosine."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 16


def _fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def embed_text(text: str | None, dim: int = DIM) -> list[float]:
    """A fixed offline embedding: each ASCII alphanumeric token adds 1 at its hash, each trigram of ^token$ a quarter."""
    v = np.zeros(dim, dtype=np.float32)
    for tok in re.findall(r"[a-z0-9]+", (text or "").lower()):
        v[_fnv1a(tok.encode()) % dim] += 1
        marked = f"^{tok}$"
        for i in range(len(marked) - 2):
            v[_fnv1a(marked[i : i + 3].encode()) % dim] += 0.25
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


def embed(text: Column, dim: int = DIM) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: embed_text(x, dim))

    return run(text)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)

    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0))


def top_k(index: DataFrame, vector: list[float], k: int = 5, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """The k rows nearest to one vector, by cosine and then id."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    return index.withColumn("score", cosine(F.col(column), q)).orderBy(F.desc("score"), id_column).limit(k)
