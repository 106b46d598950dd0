"""Iceberg tables (format 2, file-system catalog) without a connector.

Metadata, manifest lists and manifests are made and read by the driver; data by Spark. Covers create and
append with evolution of columns, identity, bucket, truncate and date-part partitions, pruning by equality,
position and equality deletes, snapshots by id, compaction and removal of orphans. Tables of other writers are read
by what the format prescribes: partition fields by source id and spec id, names and types by the current schema.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator, Mapping
from functools import reduce
from operator import and_
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import avro

_TYPES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "binary": T.BinaryType()}
_SPEC = re.compile(r"(?:(bucket|truncate)\[(\d+)\]|(year|month|day|hour))\((\w+)\)|(\w+)")


def murmur3(data: bytes) -> int:
    """murmur3 x86 32 with seed 0, as the table format prescribes."""
    m = 0xFFFFFFFF
    h, n = 0, len(data)
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    for i in range(0, n - n % 4, 4):
        h = (rot(h ^ (rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m), 13) * 5 + 0xE6546B64) & m
    if n % 4:
        h ^= rot(int.from_bytes(data[n - n % 4 :], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= n
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    return h ^ (h >> 16)


def bucket_of(x, n: int) -> int | None:
    if x is None:
        return None
    data = x.encode() if isinstance(x, str) else (int(x)).to_bytes(8, "little", signed=True)
    return (murmur3(data) & 0x7FFFFFFF) % n


def _transform(spec: str) -> tuple[str, str, str]:
    """(field name, source column, transform)"""
    m = _SPEC.fullmatch(spec.strip())
    if not m:
        raise ValueError(f"no partition: {spec!r}")
    if m[5]:
        return m[5], m[5], "identity"
    if m[1]:
        return f"{m[4]}_{'bucket' if m[1] == 'bucket' else 'trunc'}", m[4], f"{m[1]}[{m[2]}]"
    return f"{m[4]}_{m[3]}", m[4], m[3]


def _apply(source: str, transform: str, kind: T.DataType) -> Column:
    c = F.col(f"`{source}`")
    if transform == "identity":
        return c
    m = re.fullmatch(r"(\w+)(?:\[(\d+)\])?", transform)
    if m[1] == "bucket":
        n = int(m[2])

        @F.pandas_udf("int")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda x: bucket_of(None if pd.isna(x) else x if isinstance(x, str) else int(x), n)).astype("Int32")

        return run(c)
    if m[1] == "truncate":
        w = int(m[2])
        return F.substring(c, 1, w) if isinstance(kind, T.StringType) else c - F.pmod(c, F.lit(w))
    return F.date_part(F.lit(m[1]), c.cast("timestamp")).cast("int")


def _meta_dir(path: str) -> str:
    return os.path.join(path, "metadata")


def _plain(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def metadata(path: str) -> dict:
    """The current metadata: the version that the hint names, or else the highest."""
    hint = os.path.join(_meta_dir(path), "version-hint.text")
    if os.path.exists(hint):
        with open(hint, encoding="utf-8") as f:
            v = int(f.read())
        name = f"v{v}.metadata.json"
    else:
        v, name = max((int(m[1]), n) for n in os.listdir(_meta_dir(path)) if (m := re.match(r"v?(\d+)[^/]*\.metadata\.json$", n)))
    with open(os.path.join(_meta_dir(path), name), encoding="utf-8") as f:
        return json.load(f) | {"__version": v}


def exists(path: str) -> bool:
    return os.path.isdir(_meta_dir(path)) and any(n.endswith(".metadata.json") for n in os.listdir(_meta_dir(path)))


def _type(name: str) -> T.DataType:
    if m := re.fullmatch(r"decimal\((\d+), *(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    return _TYPES[name]


def current_fields(meta: dict) -> list[dict]:
    return next(s for s in meta["schemas"] if s["schema-id"] == meta["current-schema-id"])["fields"]


def schema_of(meta: dict) -> T.StructType:
    return T.StructType([T.StructField(f["name"], _type(f["type"]), True) for f in current_fields(meta)])


def spec_of(meta: dict, spec_id: int | None = None) -> list[dict]:
    """The partition fields of a spec (the default one) with the name of the source column and the type of the values."""
    want = meta.get("default-spec-id", 0) if spec_id is None else spec_id
    by_id = {f["id"]: f for s in meta["schemas"] for f in s["fields"]} | {f["id"]: f for f in current_fields(meta)}
    return [_with_source(f, by_id) for f in next(s for s in meta["partition-specs"] if s["spec-id"] == want)["fields"]]


def _with_source(f: dict, by_id: dict[int, dict]) -> dict:
    kind = by_id[f["source-id"]]
    t = kind["type"] if f["transform"] == "identity" or f["transform"].startswith("trunc") else "int"
    return f | {"source": kind["name"], "kind": t if t in ("boolean", "int", "long", "float", "double") else "string"}


def _fields(schema: T.StructType, old: list[dict], last: int) -> tuple[list[dict], int]:
    have = {f["name"]: f for f in old}
    names = {type(v): k for k, v in _TYPES.items()} | {T.ShortType: "int", T.ByteType: "int"}
    out = []
    for f in schema.fields:
        t = names[type(f.dataType)]
        if f.name in have:
            out.append(have[f.name] | {"type": t})
        else:
            last += 1
            out.append({"id": last, "name": f.name, "required": False, "type": t})
    return out, last


def _manifest_schema(parts: list[tuple[str, str]]) -> dict:
    partition = {"type": "record", "name": "r102", "fields": [{"name": n, "type": ["null", t], "default": None, "field-id": 1000 + i} for i, (n, t) in enumerate(parts)]}
    file = {"type": "record", "name": "r2", "fields": [
        {"name": "content", "type": "int", "field-id": 134}, {"name": "file_path", "type": "string", "field-id": 100}, {"name": "file_format", "type": "string", "field-id": 101},
        {"name": "partition", "type": partition, "field-id": 102}, {"name": "record_count", "type": "long", "field-id": 103}, {"name": "file_size_in_bytes", "type": "long", "field-id": 104},
        {"name": "equality_ids", "type": ["null", {"type": "array", "items": "int", "element-id": 136}], "default": None, "field-id": 135}]}
    return {"type": "record", "name": "manifest_entry", "fields": [
        {"name": "status", "type": "int", "field-id": 0}, {"name": "snapshot_id", "type": ["null", "long"], "default": None, "field-id": 1},
        {"name": "sequence_number", "type": ["null", "long"], "default": None, "field-id": 3}, {"name": "file_sequence_number", "type": ["null", "long"], "default": None, "field-id": 4}, {"name": "data_file", "type": file, "field-id": 2}]}


_LIST = {"type": "record", "name": "manifest_file", "fields": [{"name": n, "type": t, "field-id": i} for n, t, i in (("manifest_path", "string", 500), ("manifest_length", "long", 501), ("partition_spec_id", "int", 502), ("content", "int", 517), ("sequence_number", "long", 515), ("min_sequence_number", "long", 516), ("added_snapshot_id", "long", 503), ("added_files_count", "int", 504), ("existing_files_count", "int", 505), ("deleted_files_count", "int", 506), ("added_rows_count", "long", 512), ("existing_rows_count", "long", 513), ("deleted_rows_count", "long", 514))]}


def entries(path: str, meta: dict, snapshot: int | None = None) -> list[dict]:
    """Live entries of a snapshot, each with its sequence number and the id of its partition spec."""
    want = snapshot if snapshot is not None else meta.get("current-snapshot-id")
    s = next((s for s in meta["snapshots"] if s["snapshot-id"] == want), None)
    out = []
    for m in avro.read_file(_plain(s["manifest-list"])) if s else []:
        for e in avro.read_file(_plain(m["manifest_path"])):
            if e["status"] != 2:
                n = e.get("sequence_number")
                out.append(e | {"sequence_number": m.get("sequence_number", 0) if n is None else n, "spec_id": m.get("partition_spec_id", 0)})
    return out


def _commit(path: str, old: dict | None, fields: list[dict], last_column: int, spec: list[dict], added: list[dict], content: int, keep: bool, operation: str) -> int:
    os.makedirs(_meta_dir(path), exist_ok=True)
    version = old["__version"] + 1 if old else 1
    snapshot = uuid.uuid4().int >> 66
    sequence = (old["last-sequence-number"] if old else 0) + 1
    now = int(time.time() * 1000)
    lists = []
    if old and keep and old.get("current-snapshot-id", -1) != -1:
        lists = list(avro.read_file(_plain(next(s for s in old["snapshots"] if s["snapshot-id"] == old["current-snapshot-id"])["manifest-list"])))
    specs = list(old["partition-specs"]) if old else []
    bare = [{k: f[k] for k in ("name", "transform", "source-id", "field-id")} for f in spec]
    spec_id = next((s["spec-id"] for s in specs if [{k: f.get(k) for k in ("name", "transform", "source-id", "field-id")} for f in s["fields"]] == bare), None)
    if spec_id is None:
        spec_id = 1 + max((s["spec-id"] for s in specs), default=-1)
        specs.append({"spec-id": spec_id, "fields": bare})
    if added:
        kinds = [(f["name"], f["kind"]) for f in spec]
        manifest = os.path.abspath(os.path.join(_meta_dir(path), f"{uuid.uuid4()}-m0.avro"))
        avro.write_file(manifest, _manifest_schema(kinds), [{"status": 1, "snapshot_id": snapshot, "sequence_number": None, "file_sequence_number": None, "data_file": {"content": content, "file_format": "PARQUET", "equality_ids": None, **a}} for a in added], {"format-version": "2", "content": "data" if content == 0 else "deletes", "partition-spec-id": str(spec_id), "schema": json.dumps({"type": "struct", "fields": fields}), "partition-spec": json.dumps(bare)})
        rows = sum(a["record_count"] for a in added)
        lists.append({"manifest_path": manifest, "manifest_length": os.path.getsize(manifest), "partition_spec_id": spec_id, "content": 1 if content else 0, "sequence_number": sequence, "min_sequence_number": sequence, "added_snapshot_id": snapshot, "added_files_count": len(added), "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": rows, "existing_rows_count": 0, "deleted_rows_count": 0})
    manifest_list = os.path.abspath(os.path.join(_meta_dir(path), f"snap-{snapshot}-1-{uuid.uuid4()}.avro"))
    avro.write_file(manifest_list, _LIST, lists, {"format-version": "2", "snapshot-id": str(snapshot), "sequence-number": str(sequence)})
    schemas = list(old["schemas"]) if old else []
    current = next((s for s in schemas if s["fields"] == fields), None)
    if current is None:
        current = {"type": "struct", "schema-id": len(schemas), "fields": fields}
        schemas.append(current)
    entry = {"snapshot-id": snapshot, "sequence-number": sequence, "timestamp-ms": now, "summary": {"operation": operation}, "manifest-list": manifest_list, "schema-id": current["schema-id"]}
    if old and old.get("current-snapshot-id", -1) != -1:
        entry["parent-snapshot-id"] = old["current-snapshot-id"]
    meta = {"format-version": 2, "table-uuid": old["table-uuid"] if old else str(uuid.uuid4()), "location": os.path.abspath(path), "last-sequence-number": sequence, "last-updated-ms": now, "last-column-id": last_column, "schemas": schemas, "current-schema-id": current["schema-id"], "partition-specs": specs, "default-spec-id": spec_id, "last-partition-id": max([999, *(f["field-id"] for x in specs for f in x["fields"])]), "sort-orders": [{"order-id": 0, "fields": []}], "default-sort-order-id": 0, "properties": {}, "current-snapshot-id": snapshot, "snapshots": [*(old["snapshots"] if old else []), entry]}
    tmp = os.path.join(_meta_dir(path), f".{uuid.uuid4()}")
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(meta, f)
    try:
        os.link(tmp, os.path.join(_meta_dir(path), f"v{version}.metadata.json"))  # fails if another writer was first
    finally:
        os.unlink(tmp)
    hint = os.path.join(_meta_dir(path), f".{uuid.uuid4()}")
    with open(hint, "w", encoding="utf-8") as f:
        f.write(str(version))
    os.replace(hint, os.path.join(_meta_dir(path), "version-hint.text"))
    return snapshot


def _data(df: DataFrame, path: str, spec: list[dict], fields: list[dict]) -> list[dict]:
    """Data files of df under path/data, with their partition values; the columns bear their field ids."""
    stage = os.path.join(path, "data", uuid.uuid4().hex)
    names = [f"__p{i}" for i in range(len(spec))]
    ids = {f["name"]: f["id"] for f in fields}
    d = df.select(*(F.col(f"`{c}`").alias(c, metadata={"parquet.field.id": ids[c]}) for c in df.columns))
    d = d.withColumns({n: _apply(f["source"], f["transform"], df.schema[f["source"]].dataType) for n, f in zip(names, spec, strict=True)})
    (d.write.partitionBy(*names) if names else d.write).parquet(stage)
    counts = df.sparkSession.read.parquet(stage).groupBy(F.input_file_name().alias("f"), *names).agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for r in counts:
        full = os.path.abspath(os.path.join(stage, unquote(r["f"]).rpartition(os.path.basename(stage) + "/")[2]))
        values = {f["name"]: (None if r[n] is None else str(r[n]) if f["kind"] == "string" else r[n]) for n, f in zip(names, spec, strict=True)}
        out.append({"file_path": full, "partition": values, "record_count": r["n"], "file_size_in_bytes": os.path.getsize(full)})
    return out


def write(df: DataFrame, path: str, partition_by: str | list[str] | None = None) -> int:
    """Creates the table, or replaces its rows as a new snapshot."""
    specs = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    old = metadata(path) if exists(path) else None
    fields, last = _fields(df.schema, current_fields(old) if old else [], old["last-column-id"] if old else 0)
    spec = []
    for i, s in enumerate(specs):
        name, source, transform = _transform(s)
        kind = next(f for f in fields if f["name"] == source)
        spec.append(_with_source({"name": name, "transform": transform, "source-id": kind["id"], "field-id": 1000 + i}, {kind["id"]: kind}))
    return _commit(path, old, fields, last, spec, _data(df, path, spec, fields), 0, False, "overwrite" if old else "append")


def append(df: DataFrame, path: str) -> int:
    from .delta import merged

    if not exists(path):
        return write(df, path)
    old = metadata(path)
    schema = merged(schema_of(old), df.schema)
    fields, last = _fields(schema, current_fields(old), old["last-column-id"])
    df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))
    spec = spec_of(old)
    return _commit(path, old, fields, last, spec, _data(df, path, spec, fields), 0, True, "append")


def _pruned(e: dict, spec: list[dict], where: Mapping) -> bool:
    for f in spec:
        if f["source"] not in where:
            continue
        want, have = where[f["source"]], e["data_file"]["partition"].get(f["name"])
        if f["transform"] == "identity" and (have is None or want is None or str(have) != str(want)):
            return have is not None or want is not None
        if f["transform"].startswith("bucket") and have != bucket_of(want, int(f["transform"][7:-1])):
            return True
        if f["transform"].startswith("truncate") and want is not None and not isinstance(want, float):
            w = int(f["transform"][9:-1])
            if str(have) != (want[:w] if isinstance(want, str) else str(want - want % w)):
                return True
    return False


def _scan(spark: SparkSession, path: str, meta: dict, live: list[dict], where: Mapping, places: bool = False) -> DataFrame:
    """Live rows. An equality delete bears on the files of lower sequence numbers, so files are read in groups that the
    same deletes bear on."""
    schema = schema_of(meta)
    specs = {s["spec-id"]: spec_of(meta, s["spec-id"]) for s in meta["partition-specs"]}
    data = [e for e in live if e["data_file"].get("content", 0) == 0 and not _pruned(e, specs[e["spec_id"]], where)]
    deletes = [_plain(e["data_file"]["file_path"]) for e in live if e["data_file"].get("content", 0) == 1]
    equal = [e for e in live if e["data_file"].get("content", 0) == 2]
    if any(v is not None for e in equal for v in e["data_file"]["partition"].values()):
        raise NotImplementedError("equality deletes of one partition")
    if not data:
        df = spark.createDataFrame([], schema)
        return df.withColumns({"__file": F.lit(""), "__row": F.lit(0).cast("long")}) if places else df
    steps = sorted({e["sequence_number"] for e in equal})
    groups: dict[int, list[str]] = {}
    for e in data:
        groups.setdefault(sum(n <= e["sequence_number"] for n in steps), []).append(_plain(e["data_file"]["file_path"]))
    names = {f["id"]: f["name"] for f in current_fields(meta)}
    parts = []
    for first, files in groups.items():
        df = spark.read.schema(schema).parquet(*files)
        if deletes or places:
            df = df.select(*schema.names, F.regexp_replace(_decoded("_metadata.file_path"), "^file:/*", "/").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        by_columns: dict[tuple, list[str]] = {}
        for e in equal:
            if e["sequence_number"] in steps[first:]:
                by_columns.setdefault(tuple(e["data_file"]["equality_ids"]), []).append(_plain(e["data_file"]["file_path"]))
        for ids, gone_files in by_columns.items():
            columns = [names[i] for i in ids]
            gone = spark.read.schema(T.StructType([schema[c] for c in columns])).parquet(*gone_files).distinct()
            gone = gone.select(*(F.col(f"`{c}`").alias(f"__e{i}") for i, c in enumerate(columns)))
            on = [F.col(f"`{c}`").eqNullSafe(F.col(f"__e{i}")) for i, c in enumerate(columns)]
            df = df.join(gone, reduce(and_, on), "left_anti")
        parts.append(df)
    df = reduce(DataFrame.unionAll, parts)
    if deletes:
        gone = spark.read.schema("file_path string, pos long").parquet(*deletes).select(F.regexp_replace("file_path", "^file:/*", "/").alias("__gone"), "pos")
        df = df.join(gone, (df["__file"] == gone["__gone"]) & (df["__row"] == gone["pos"]), "left_anti")
    for k, v in where.items():
        df = df.where(F.col(f"`{k}`").eqNullSafe(F.lit(v)))
    return df if places else df.select(*schema.names)


def _decoded(c: str) -> Column:
    return F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))


def read(spark: SparkSession, path: str, where: Mapping | None = None, snapshot: int | None = None) -> DataFrame:
    meta = metadata(path)
    return _scan(spark, path, meta, entries(path, meta, snapshot), dict(where or {}))


def delete(spark: SparkSession, path: str, where: Mapping, mode: str = "position") -> int:
    """Deletes the rows that equal `where`, by a position-delete file or (mode "equality") by one that holds the values;
    how many they were. None: no commit."""
    if mode not in ("position", "equality"):
        raise ValueError(f"no mode {mode!r}")
    meta = metadata(path)
    spec, fields = spec_of(meta), current_fields(meta)
    empty = {f["name"]: None for f in spec}
    stage = os.path.join(path, "data", f"delete-{uuid.uuid4().hex}")
    if mode == "equality":
        n = _scan(spark, path, meta, entries(path, meta), where).count()
        if n:
            kinds = {f["name"]: f for f in fields}
            row = spark.range(1).select(*(F.lit(v).cast(_type(kinds[k]["type"])).alias(k, metadata={"parquet.field.id": kinds[k]["id"]}) for k, v in where.items()))
            row.coalesce(1).write.parquet(stage)
            files = [os.path.abspath(os.path.join(stage, f)) for f in os.listdir(stage) if f.endswith(".parquet")]
            _commit(path, meta, fields, meta["last-column-id"], spec, [{"file_path": f, "partition": empty, "record_count": 1, "file_size_in_bytes": os.path.getsize(f), "equality_ids": [kinds[k]["id"] for k in where]} for f in files], 2, True, "delete")
        return n
    found = _scan(spark, path, meta, entries(path, meta), where, places=True).select(F.col("__file").alias("file_path"), F.col("__row").alias("pos"))
    found.repartitionByRange("file_path", "pos").sortWithinPartitions("file_path", "pos").write.parquet(stage)
    n = spark.read.parquet(stage).count()
    if n:
        files = [os.path.abspath(os.path.join(stage, f)) for f in os.listdir(stage) if f.endswith(".parquet")]
        _commit(path, meta, fields, meta["last-column-id"], spec, [{"file_path": f, "partition": empty, "record_count": n, "file_size_in_bytes": os.path.getsize(f)} for f in files], 1, True, "delete")
    return n


def optimize(spark: SparkSession, path: str, files: int = 1) -> int:
    """Rewrites the live rows in fewer files under the same partitions."""
    meta = metadata(path)
    df = _scan(spark, path, meta, entries(path, meta), {})
    spec, fields = spec_of(meta), current_fields(meta)
    return _commit(path, meta, fields, meta["last-column-id"], spec, _data(df.coalesce(files), path, spec, fields), 0, False, "replace")


def vacuum(path: str) -> int:
    """Deletes files under data/ that no snapshot has."""
    meta = metadata(path)
    named = {_plain(e["data_file"]["file_path"]) for s in meta["snapshots"] for e in entries(path, meta, s["snapshot-id"])}
    n = 0
    for d, _, names in os.walk(os.path.join(path, "data")):
        for f in names:
            full = os.path.abspath(os.path.join(d, f))
            if f.endswith(".parquet") and full not in named:
                os.unlink(full)
                n += 1
    return n
