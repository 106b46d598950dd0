"""SQL databases through the driver: sqlite:///path and duckdb:///path in process, others by JDBC."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*$")


@contextmanager
def connection(url: str) -> Iterator:
    scheme, _, path = url.partition(":")
    path = path.removeprefix("//")
    if scheme == "sqlite":
        c = sqlite3.connect(path or ":memory:", isolation_level=None)
    elif scheme == "duckdb":
        import duckdb

        c = duckdb.connect(path or ":memory:")
    else:
        raise ValueError(f"{scheme}: use jdbc()")
    try:
        yield c
    finally:
        c.close()


def _cell(x):
    if isinstance(x, bytes):
        return "0x" + x.hex()
    return int(x) if isinstance(x, bool) else x if x is None or isinstance(x, (int, float, str)) else str(x)


def query(spark: SparkSession, url: str, sql: str, params: list | None = None) -> DataFrame:
    """A parametrised SELECT as a table; integers, doubles and texts, other types as text, blobs as 0x...."""
    with connection(url) as c:
        cursor = c.execute(sql, params or [])
        names = [d[0] for d in cursor.description]
        rows = [tuple(map(_cell, r)) for r in cursor.fetchall()]
    fields = []
    for i, n in enumerate(names):
        kinds = {type(r[i]) for r in rows if r[i] is not None}
        fields.append(T.StructField(n, T.LongType() if kinds == {int} else T.DoubleType() if kinds and kinds <= {int, float} else T.StringType()))
    cast = [float if isinstance(f.dataType, T.DoubleType) else str if isinstance(f.dataType, T.StringType) else int for f in fields]
    return spark.createDataFrame([tuple(None if x is None else k(x) for x, k in zip(r, cast, strict=True)) for r in rows], T.StructType(fields))


def pushed(sql: str, columns: list[str] | None = None, where: Mapping | None = None, limit: int | None = None, params: list | None = None) -> tuple[str, list]:
    """The query with columns, equalities and limit handed to the database."""
    if where and any("?" in x for x in re.split(r"'(?:[^']|'')*'|\"[^\"]*\"", sql)):
        raise ValueError("a query with placeholders takes no further conditions")
    for n in [*(columns or []), *(where or {})]:
        if not _NAME.match(n):
            raise ValueError(f"not a column name: {n!r}")
    out = f"SELECT {', '.join(columns) if columns else '*'} FROM ({sql.rstrip().rstrip(';')}) AS q"
    conditions = [f"{k} IS NULL" if v is None else f"{k} = ?" for k, v in (where or {}).items()]
    if conditions:
        out += " WHERE " + " AND ".join(conditions)
    if limit is not None:
        out += f" LIMIT {int(limit)}"
    return out, [*(params or []), *(v for v in (where or {}).values() if v is not None)]


def inlined(sql: str, params: list) -> str:
    """The query with its parameters in place of the question marks outside of quotes, for databases behind JDBC."""
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\")", sql)
    left = list(params)

    def value(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return repr(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    for i in range(0, len(parts), 2):
        pieces = parts[i].split("?")
        for j in range(len(pieces) - 1):
            if not left:
                raise ValueError("fewer parameters than placeholders")
            pieces[j] += value(left.pop(0))
        parts[i] = "".join(pieces)
    if left:
        raise ValueError("more parameters than placeholders")
    return "".join(parts)


def execute(url: str, sql: str, params: list | None = None) -> None:
    with connection(url) as c:
        c.execute(sql, params or [])


def transaction(url: str, steps: list[Mapping]) -> None:
    """All steps ({sql, params}) or none; the error names the step."""
    with connection(url) as c:
        c.execute("BEGIN")
        for i, s in enumerate(steps):
            try:
                c.execute(s["sql"], s.get("params") or [])
            except Exception as e:
                c.execute("ROLLBACK")
                raise RuntimeError(f"step {i}: {e}") from e
        c.execute("COMMIT")


def jdbc(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()
