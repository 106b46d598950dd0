"""Clustering by a space-filling curve at write time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def _scaled(v: V.Value, lo: str, hi: str, bits: int) -> Column:
    x = F.xxhash64(V.display(v)).cast("double") if v.kind == V.TEXT else V.number(v).cast("double")
    span = F.col(hi) - F.col(lo)
    return F.when(span > 0, F.least((x - F.col(lo)) / span * float(2**bits - 1), F.lit(float(2**bits - 1)))).otherwise(F.lit(0.0)).cast("long")


def key(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """df beside the columns' ranges, and the Morton number: each column scaled to its range, bits interleaved."""
    if not 1 <= len(set(columns)) == len(columns) <= 8:
        raise ValueError("1 to 8 distinct columns")
    bits = min(16, 63 // len(columns))
    vs = [V.column(c, df.schema) for c in columns]
    aggs = []
    for i, v in enumerate(vs):
        x = F.xxhash64(V.display(v)).cast("double") if v.kind == V.TEXT else V.number(v).cast("double")
        aggs += [F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
    r = df.agg(*aggs).first()
    ranged = df.withColumns({k: F.lit(r[k]) for k in r.asDict()})
    morton = F.lit(0).cast("long")
    for i, v in enumerate(vs):
        s = _scaled(v, f"__lo{i}", f"__hi{i}", bits)
        for b in range(bits):
            morton = morton.bitwiseOR(F.shiftleft(F.shiftright(s, b).bitwiseAND(F.lit(1).cast("long")), b * len(vs) + len(vs) - 1 - i))
    return ranged, morton


def clustered(df: DataFrame, columns: list[str], files: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by the Morton number: an external sort, no collection."""
    ranged, m = key(df, columns)
    d = ranged.withColumn("__z", m)
    d = d.repartitionByRange(files, "__z") if files else d.repartitionByRange("__z")
    return d.sortWithinPartitions("__z").select(*df.columns)
