"""Aggregation pipelines of document stores, as DataFrame plans: $match $project $group $sort $skip $limit $count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"$eq": lambda c, x: c.eqNullSafe(F.lit(x)), "$ne": lambda c, x: ~c.eqNullSafe(F.lit(x)), "$gt": lambda c, x: c > x, "$gte": lambda c, x: c >= x, "$lt": lambda c, x: c < x, "$lte": lambda c, x: c <= x, "$in": lambda c, x: c.isin(list(x)), "$nin": lambda c, x: ~c.isin(list(x))}


def match(query: dict) -> Column:
    parts = []
    for k, v in query.items():
        if k in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), [match(q) for q in v]))
        elif isinstance(v, dict):
            parts += [F.coalesce(_COMPARE[op](F.col(k), x), F.lit(False)) for op, x in v.items()]
        else:
            parts.append(F.col(k).eqNullSafe(F.lit(v)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _value(x) -> Column:
    return F.col(x[1:]) if isinstance(x, str) and x.startswith("$") else F.lit(x)


def aggregate(df: DataFrame, stages: list[dict]) -> DataFrame:
    for stage in stages:
        ((op, arg),) = stage.items()
        if op == "$match":
            df = df.where(match(arg))
        elif op == "$project":
            if all(v in (0, False) for v in arg.values()):
                df = df.drop(*arg)
            else:
                df = df.select(*((F.col(k) if v in (1, True) else _value(v)).alias(k) for k, v in arg.items() if v not in (0, False)))
        elif op == "$group":
            key = arg["_id"]
            keys = [] if key is None else [_value(v).alias(k) for k, v in key.items()] if isinstance(key, dict) else [_value(key).alias("_id")]
            aggs = []
            for k, v in arg.items():
                if k == "_id":
                    continue
                ((f, x),) = v.items()
                aggs.append({"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first}[f](_value(x)).alias(k))
            df = df.groupBy(*keys).agg(*aggs)
        elif op == "$sort":
            df = df.orderBy(*(F.col(k).asc_nulls_first() if v > 0 else F.col(k).desc_nulls_last() for k, v in arg.items()))
        elif op == "$limit":
            df = df.limit(arg)
        elif op == "$skip":
            df = df.offset(arg)
        elif op == "$count":
            df = df.groupBy().agg(F.count(F.lit(1)).alias(arg))
        else:
            raise ValueError(f"no stage {op}")
    return df


def find(df: DataFrame, query: dict | None = None, only: list[str] | None = None, most: int = 100) -> DataFrame:
    df = df.where(match(query or {}))
    return (df.select(*only) if only else df).limit(most)
