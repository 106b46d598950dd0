"""Connected components over written tables, and bounded membership filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spent, written
from ._text import U, mix

__all__ = ["bloom", "components", "in_bloom", "spent", "written"]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for edges (a, b) of longs: the least node that is reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every step joins nothing and
    sends each node's neighbours to the node once; minima are taken by aggregation. Ends when no
    edge changes."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, "edges")

    def print_of(x: DataFrame) -> tuple:
        r = x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    before = print_of(e)
    for _ in range(rounds if before[0] else 0):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        small = small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        old, e = e, written(small, "edges")
        spent(old)
        after = print_of(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components: not settled")
    members = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return members.union(e.select("b", F.col("b").alias("c")).distinct())


#: Bits of the largest filter (16 MB) and places that a key has in a filter.
MOST_BITS, PLACES = 1 << 27, 4


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The places of each key (int64), a column for each; bits: a power of two."""
    h = mix(keys.view(U) + U(0x9E3779B97F4A7C15))
    step = mix(h) | U(1)
    return np.column_stack([(h + U(i) * step) & U(bits - 1) for i in range(PLACES)])


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys of a frame of one long column: 16 bits a key, at most MOST_BITS. Beyond that it lets
    more through; what uses it joins exactly afterwards."""
    n = keys.count()
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * max(1, n) - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = np.unique(_places(b.column(0).to_numpy(), bits))
            word = (at >> U(6)).astype(np.int32)
            cut = np.flatnonzero(np.diff(word, prepend=-1))
            part = np.bitwise_or.reduceat(U(1) << (at & U(63)), cut) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word[cut]), pa.array(part.view(np.int64))], names=["w", "b"])

    words = keys.mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most MOST_BITS / 64 rows
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(U)


def in_bloom(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys (int64) may be among the filter's; False is certain."""
    at = _places(keys, len(table) * 64)
    return ((table[at >> U(6)] >> (at & U(63))) & U(1) == 1).all(axis=1)
