"""CSV, JSON and Parquet files."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT = r"^[ \t\n\x0b\f\r]*[+-]?[0-9]+$"
_DEC = r"(?i)^[ \t\n\x0b\f\r]*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|nan|inf|infinity)$"


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Header row; an empty cell is an empty text, a missing one null. A column is of integers or doubles if all its
    cells are (one aggregation over the file finds out), else text."""
    options = {"header": True, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "emptyValue": ""}
    names = spark.read.csv(path, **options).columns
    bad = "__bad_row"
    df = spark.read.csv(path, schema=T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]]), columnNameOfCorruptRecord=bad, enforceSchema=True, **options)
    # the parser gives null for an empty cell and for a missing one; rows of another length are marked
    df = df.select(*(F.when(F.col(f"`{n}`").isNull() & F.col(bad).isNull(), F.lit("")).otherwise(F.col(f"`{n}`")).alias(n) for n in names))
    if not infer or not df.columns:
        return df
    checks = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        checks += [F.min(x.rlike(_INT)).alias(f"i{i}"), F.min(x.rlike(_INT) | x.rlike(_DEC)).alias(f"d{i}")]
    r = df.agg(*checks).first()
    trimmed = {c: F.ltrim(F.col(f"`{c}`")) for c in df.columns}

    def typed(i: int, c: str) -> Column:
        if r[f"i{i}"]:
            return F.coalesce(trimmed[c].try_cast("long"), F.when(F.startswith(trimmed[c], F.lit("-")), F.lit(-(2**63))).when(trimmed[c].isNotNull(), F.lit(2**63 - 1)))
        return F.regexp_replace(F.lower(trimmed[c]), "^([+-]?)inf$", "$1infinity").cast("double") if r[f"d{i}"] else F.col(f"`{c}`")

    return df.select(*(typed(i, c).alias(c) for i, c in enumerate(df.columns)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str) -> DataFrame | dict:
    """An array of objects as a table; a single object as a dict."""
    if "://" not in path and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            head = f.read(4096).lstrip()
        if head.startswith("{"):
            with open(path, encoding="utf-8") as f:
                return json.load(f)
    return spark.read.json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    """One pretty-printed array, written by the driver row by row as partitions arrive."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, line in enumerate(df.toJSON().toLocalIterator()):
            f.write((",\n" if i else "\n") + json.dumps(json.loads(line), ensure_ascii=False, indent=2))
        f.write("\n]\n")


def read_parquet(spark: SparkSession, path: str, iso_text: bool = False) -> DataFrame:
    """With iso_text, dates and times become ISO-8601 texts and fixed decimals doubles."""
    df = spark.read.parquet(path)
    if not iso_text:
        return df
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0+$", "")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_parquet(df: DataFrame, path: str, codec: str = "gzip", types: dict[str, str] | None = None, pages: str = "v1", dictionary: bool = True, one_file: bool = False) -> None:
    """types: column to int32, float, decimal(p,s) or uuid (kept as text)."""
    for c, t in (types or {}).items():
        df = df.withColumn(c, F.col(f"`{c}`").cast({"int32": "int", "uuid": "string"}.get(t, t)))
    w = (df.coalesce(1) if one_file else df).write.mode("overwrite").option("compression", codec)
    w.option("parquet.writer.version", {"v1": "PARQUET_1_0", "v2": "PARQUET_2_0"}[pages]).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
