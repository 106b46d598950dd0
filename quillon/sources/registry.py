"""Sources declared by fields: one reader for every kind."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from . import delta, files, iceberg, sql

#: Fields that may name the place, the first that is there counts.
PLACES = ("caminho", "arquivo", "url", "path")


class UnknownSource(ValueError):
    pass


def _place(fields: Mapping) -> str:
    found = next((str(fields[k]) for k in PLACES if fields.get(k)), "")
    if not found:
        raise ValueError(f"a source needs one of {', '.join(PLACES)}")
    return found


def _database(kind: str) -> Callable[[SparkSession, Mapping], DataFrame]:
    """Embedded databases in process; others by JDBC, for which their driver's jar must be there."""

    def read(spark: SparkSession, fields: Mapping) -> DataFrame:
        text = fields.get("consulta") or fields.get("query")
        if not text:
            raise ValueError(f"a source of kind {kind} needs consulta")
        push = fields.get("pushdown") or {}
        params = list(fields.get("params") or [])
        if push:
            text, params = sql.pushed(text, push.get("colunas"), push.get("onde"), push.get("limite"), params)
        url = _place(fields)
        if kind in ("sqlite", "duckdb"):
            return sql.query(spark, url if url.startswith(f"{kind}:") else f"{kind}://{url}", text, params)
        return sql.jdbc(spark, url if url.startswith("jdbc:") else f"jdbc:{url}", sql.inlined(text, params), **fields.get("options", {}))

    return read


def _kafka(spark: SparkSession, fields: Mapping) -> DataFrame:
    """The records of a topic as texts; with `fluxo` as a stream. Needs Spark's Kafka package."""
    options = {"kafka.bootstrap.servers": fields.get("broker") or _place(fields), "subscribe": fields["topico"], "startingOffsets": {"inicio": "earliest", "fim": "latest"}.get(fields.get("desde", "inicio"), "earliest")}
    if fields.get("grupo"):
        options["kafka.group.id"] = fields["grupo"]
    reader = (spark.readStream if fields.get("fluxo") else spark.read).format("kafka").options(**options)
    out = reader.load().selectExpr("cast(key as string) as key", "cast(value as string) as value", "topic", "partition", "offset", "timestamp")
    return out if fields.get("fluxo") else out.limit(int(fields.get("max", 100)))


READERS: dict[str, Callable[[SparkSession, Mapping], DataFrame]] = {
    "csv": lambda spark, f: files.read_csv(spark, _place(f)),
    "json": lambda spark, f: files.read_json(spark, _place(f)),
    "parquet": lambda spark, f: files.read_parquet(spark, _place(f)),
    "delta": lambda spark, f: delta.read(spark, _place(f), f.get("onde"), f.get("versao")),
    "iceberg": lambda spark, f: iceberg.read(spark, _place(f), f.get("onde")),
    "kafka": _kafka,
    **{k: _database(k) for k in ("sqlite", "duckdb", "postgres", "mysql", "clickhouse")},
}


def read(spark: SparkSession, fields: Mapping) -> DataFrame:
    """The table that a source's fields describe: `tipo` names its kind."""
    kind = fields.get("tipo")
    if kind not in READERS:
        raise UnknownSource(f"no source of kind {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, fields)


ler = read
