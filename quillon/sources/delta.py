"""Delta tables without a connector: the driver replays and writes the JSON log, Spark reads and writes the data.

Covers overwrite, append with schema evolution (new columns, int to long, float to double), Hive
partitions, pruning by equality, time travel, change feed, deletion vectors, compaction, vacuum and checkpoints.
Paths are of a file system that the driver sees.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Mapping
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmaps, zorder
from .shared import spent, written

CHECKPOINT_EVERY = 10
WIDER = {("integer", "long"), ("short", "long"), ("byte", "long"), ("float", "double"), ("short", "integer"), ("byte", "integer"), ("byte", "short")}


class Conflict(Exception):
    """Another writer took the version."""


def _identity(file: dict) -> tuple:
    """What a file of the log is known by: its path and its deletion vector."""
    v = file.get("deletionVector") or {}
    return file["path"], v.get("storageType"), v.get("pathOrInlineDv"), v.get("offset")


class State:
    """What the log says at a version."""

    def __init__(self):
        self.version, self.files, self.meta, self.protocol = -1, {}, None, None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.meta["schemaString"]))

    @property
    def partitions(self) -> list[str]:
        return self.meta.get("partitionColumns", [])

    def apply(self, action: dict) -> None:
        if "add" in action and action["add"]:
            self.files[_identity(action["add"])] = action["add"]
        elif "remove" in action and action["remove"]:
            self.files.pop(_identity(action["remove"]), None)
        elif "metaData" in action and action["metaData"]:
            self.meta = action["metaData"]
        elif "protocol" in action and action["protocol"]:
            self.protocol = action["protocol"]


def _log(path: str) -> str:
    return os.path.join(path, "_delta_log")


def versions(path: str) -> list[int]:
    return sorted(int(f[:20]) for f in (os.listdir(_log(path)) if os.path.isdir(_log(path)) else []) if f.endswith(".json") and f[:20].isdigit())


def _actions(path: str, version: int) -> list[dict]:
    with open(os.path.join(_log(path), f"{version:020d}.json"), encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def _plain(x):
    """Maps of a checkpoint as dicts, and without what is null."""
    if isinstance(x, dict):
        return {k: dict(v) if k in ("partitionValues", "tags", "configuration", "options") and isinstance(v, list) else _plain(v) for k, v in x.items() if v is not None}
    return x


def replay(path: str, version: int | None = None) -> State:
    s = State()
    every = versions(path)
    checkpoints = sorted(f for f in (os.listdir(_log(path)) if os.path.isdir(_log(path)) else []) if f.endswith(".checkpoint.parquet"))
    checkpoints = [f for f in checkpoints if version is None or int(f[:20]) <= version]
    if checkpoints:
        for row in pq.read_table(os.path.join(_log(path), checkpoints[-1])).to_pylist():
            s.apply(_plain({k: v for k, v in row.items() if v is not None}))
        s.version = int(checkpoints[-1][:20])
    for v in every:
        if v > s.version and (version is None or v <= version):
            for a in _actions(path, v):
                s.apply(a)
            s.version = v
    if s.meta is None or (version is not None and s.version != version):
        raise FileNotFoundError(f"no Delta table at {path}" + (f" with version {version}" if version is not None else ""))
    return s


def _matches(value: str | None, want, t: T.DataType) -> bool:
    if value is None or want is None:
        return False  # a null partition matches nothing
    if isinstance(t, (T.NumericType,)) and not isinstance(want, str):
        return float(value) == float(want)
    return value == (str(want).lower() if isinstance(want, bool) else str(want))


def _decoded(c: Column) -> Column:
    """A path or value without its escapes; "+" stands for itself in paths."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _at(c: str) -> Column:
    """A plain path from a file's URI."""
    return _decoded(F.regexp_replace(c, "^file:/*", "/"))


def _full(path: str, file: dict) -> str:
    return os.path.abspath(os.path.join(path, unquote(file["path"])))


def _named(file: dict, partitions: list[str]) -> bool:
    """Whether the folders of a file's path spell its partition values."""
    found = {}
    for part in unquote(file["path"]).split("/")[:-1]:
        k, eq, v = part.partition("=")
        if eq:
            found[unquote(k)] = None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)
    return all(p in found and found[p] == file["partitionValues"].get(p) for p in partitions)


def _files(spark: SparkSession, path: str, files: list[dict], schema: T.StructType, partitions: list[str]) -> DataFrame:
    """The rows of whole data files, with __file and __row. Partition values are those of the log: read off the folder
    names where all of them agree with it, else joined by path."""
    data = T.StructType([f for f in schema.fields if f.name not in partitions])
    df = spark.read.schema(data).parquet(*(_full(path, f) for f in files))
    df = df.select(*(F.col(f"`{f.name}`") for f in data.fields), _at("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    if all(_named(f, partitions) for f in files):
        for p in partitions:
            raw = F.regexp_extract("__file", rf"/{re.escape(_escaped(p))}=([^/]*)/", 1)
            raw = F.when(raw == "__HIVE_DEFAULT_PARTITION__", None).otherwise(_decoded(raw))
            df = df.withColumn(p, raw.cast(schema[p].dataType))
    else:
        names = [f"__p{i}" for i in range(len(partitions))]
        known = spark.createDataFrame([(_full(path, f), *(f["partitionValues"].get(p) for p in partitions)) for f in files], T.StructType([T.StructField(n, T.StringType()) for n in ("__file", *names)]))
        df = df.join(known, "__file", "left").withColumns({p: F.col(n).cast(schema[p].dataType) for p, n in zip(partitions, names, strict=True)})
    return df.select(*(F.col(f"`{n}`") for n in schema.names), "__file", "__row")


def _escaped(name: str) -> str:
    """As the writer escapes a column's name in a folder's."""
    return "".join(c if c not in '"#%\'*/:=?\\{[]^\x7f' and ord(c) >= 32 else f"%{ord(c):02X}" for c in name)


def _deleted(spark: SparkSession, path: str, files: list[dict]) -> DataFrame:
    """(__file, __row): the rows that the files' deletion vectors mark; decoded by the tasks."""
    inline, stored = [], []
    for f in files:
        v = f.get("deletionVector")
        if not v:
            continue
        if v["storageType"] == "i":
            inline.append((_full(path, f), bytearray(bitmaps.z85_decode(v["pathOrInlineDv"])[: v["sizeInBytes"]])))
        else:
            at = os.path.join(path, bitmaps.file_name(v["pathOrInlineDv"])) if v["storageType"] == "u" else unquote(v["pathOrInlineDv"].removeprefix("file://"))
            stored.append((_full(path, f), os.path.abspath(at), v.get("offset") or 0, v["sizeInBytes"]))

    def run(batches):
        for b in batches:
            names, data, offsets, sizes = (b.column(i).to_pylist() for i in range(4))
            for name, x, offset, size in zip(names, data, offsets, sizes, strict=True):
                rows = bitmaps.decode(x if offset is None else bitmaps.unframed(x, offset, size))
                for i in range(0, len(rows), 1 << 16):
                    part = pa.array(rows[i : i + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), part], names=["__file", "__row"])

    d = spark.createDataFrame([(n, x, None, None) for n, x in inline], "__file string, data binary, offset int, size int")
    if stored:
        found = spark.read.format("binaryFile").load([p for _, p, _, _ in dict((s[1], s) for s in stored).values()])
        found = found.select(_at("path").alias("at"), F.col("content").alias("data"))
        d = d.unionAll(spark.createDataFrame(stored, "__file string, at string, offset int, size int").join(found, "at").select("__file", "data", "offset", "size"))
    return d.mapInArrow(run, "__file string, __row long")


def _places(spark: SparkSession, path: str, files: list[dict], schema: T.StructType, partitions: list[str]) -> DataFrame:
    """The rows that the files' deletion vectors leave, with __file and __row."""
    whole = [f for f in files if not f.get("deletionVector")]
    marked = [f for f in files if f.get("deletionVector")]
    parts = [_files(spark, path, whole, schema, partitions)] if whole else []
    if marked:
        parts.append(_files(spark, path, marked, schema, partitions).join(_deleted(spark, path, marked), ["__file", "__row"], "left_anti").select(*(F.col(f"`{n}`") for n in schema.names), "__file", "__row"))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def _scan(spark: SparkSession, path: str, files: list[dict], schema: T.StructType, partitions: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return _places(spark, path, files, schema, partitions).select(*(F.col(f"`{n}`") for n in schema.names))


def read(spark: SparkSession, path: str, where: Mapping | None = None, version: int | None = None) -> DataFrame:
    s = replay(path, version)
    where = dict(where or {})
    fixed = {k: v for k, v in where.items() if k in s.partitions}
    adds = [a for a in s.files.values() if all(_matches(a["partitionValues"].get(k), v, s.schema[k].dataType) for k, v in fixed.items())]
    df = _scan(spark, path, adds, s.schema, s.partitions)
    for k, v in where.items():
        if k not in fixed:
            df = df.where(F.col(f"`{k}`").eqNullSafe(F.lit(v)))
    return df


def _commit(path: str, version: int, actions: list[dict]) -> None:
    """Puts the version's file in place if nobody has: a link to a complete file either succeeds or conflicts."""
    os.makedirs(_log(path), exist_ok=True)
    tmp = os.path.join(_log(path), f".{uuid.uuid4().hex}.tmp")
    with open(tmp, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(a, separators=(",", ":")) + "\n" for a in actions)
    try:
        os.link(tmp, os.path.join(_log(path), f"{version:020d}.json"))
    except FileExistsError:
        raise Conflict(f"version {version} of {path} exists") from None
    finally:
        os.unlink(tmp)
    if version and version % CHECKPOINT_EVERY == 0:
        checkpoint(path)


_VECTOR = pa.struct([("storageType", pa.string()), ("pathOrInlineDv", pa.string()), ("offset", pa.int32()), ("sizeInBytes", pa.int32()), ("cardinality", pa.int64())])
_TEXTS = pa.map_(pa.string(), pa.string())
_CHECKPOINT = pa.schema([
    ("protocol", pa.struct([("minReaderVersion", pa.int32()), ("minWriterVersion", pa.int32()), ("readerFeatures", pa.list_(pa.string())), ("writerFeatures", pa.list_(pa.string()))])),
    ("metaData", pa.struct([("id", pa.string()), ("format", pa.struct([("provider", pa.string()), ("options", _TEXTS)])), ("schemaString", pa.string()), ("partitionColumns", pa.list_(pa.string())), ("configuration", _TEXTS), ("createdTime", pa.int64())])),
    ("add", pa.struct([("path", pa.string()), ("partitionValues", _TEXTS), ("size", pa.int64()), ("modificationTime", pa.int64()), ("dataChange", pa.bool_()), ("deletionVector", _VECTOR)])),
])


def checkpoint(path: str) -> int:
    """Writes what the log says at its last version as one Parquet file, from which replay() starts."""
    s = replay(path)
    rows = [{"protocol": s.protocol}, {"metaData": s.meta}, *({"add": a | {"dataChange": False}} for a in s.files.values())]

    def pairs(x):  # maps as pyarrow takes them
        return {k: list(v.items()) if k in ("partitionValues", "configuration", "options") and isinstance(v, dict) else pairs(v) for k, v in x.items()} if isinstance(x, dict) else x

    name = f"{s.version:020d}.checkpoint.parquet"
    tmp = os.path.join(_log(path), f".{uuid.uuid4().hex}.tmp")
    pq.write_table(pa.Table.from_pylist([pairs(r) for r in rows], _CHECKPOINT), tmp)
    os.replace(tmp, os.path.join(_log(path), name))
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump({"version": s.version, "size": len(rows)}, f)
    os.replace(tmp, os.path.join(_log(path), "_last_checkpoint"))
    return s.version


def _write_files(df: DataFrame, path: str, partitions: list[str], z_order: list[str] | None, change: bool = True) -> list[dict]:
    """Data files under path, first in a folder of their own so that they are listed exactly once; adds for the log."""
    stage = os.path.join(path, f"_stage_{uuid.uuid4().hex}")
    if z_order:
        df = zorder.clustered(df, z_order)
    w = df.write.option("compression", "snappy")
    (w.partitionBy(*partitions) if partitions else w).parquet(stage)
    adds = []
    for d, _, names in os.walk(stage):
        for n in sorted(names):
            if not n.endswith(".parquet"):
                continue
            rel = os.path.relpath(d, stage)
            values = {}
            for part in [] if rel == "." else rel.split(os.sep):
                k, _, v = part.partition("=")
                values[unquote(k)] = None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)
            target = os.path.join(path, "" if rel == "." else rel, n)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.rename(os.path.join(d, n), target)
            adds.append({"add": {"path": quote(os.path.relpath(target, path)), "partitionValues": values, "size": os.path.getsize(target), "modificationTime": int(time.time() * 1000), "dataChange": change}})
    for d, _, names in os.walk(stage, topdown=False):
        for n in names:
            os.unlink(os.path.join(d, n))
        os.rmdir(d)
    return adds


def _meta(schema: T.StructType, partitions: list[str], table_id: str | None = None) -> dict:
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return {"metaData": {"id": table_id or str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": nullable.json(), "partitionColumns": partitions, "configuration": {}, "createdTime": int(time.time() * 1000)}}


def _remove(add: dict, now: int, change: bool = True) -> dict:
    kept = {k: add[k] for k in ("path", "partitionValues", "size", "deletionVector") if add.get(k) is not None}
    return {"remove": kept | {"deletionTimestamp": now, "dataChange": change, "extendedFileMetadata": True}}


def _info(operation: str) -> dict:
    return {"commitInfo": {"timestamp": int(time.time() * 1000), "operation": operation, "operationParameters": {}}}


def write(df: DataFrame, path: str, partition_by: str | list[str] | None = None, z_order: list[str] | None = None) -> int:
    """Overwrites: a table that exists gets a new version whose files replace all former ones."""
    partitions = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    os.makedirs(path, exist_ok=True)
    old = replay(path) if versions(path) else None
    adds = _write_files(df, path, partitions, z_order)
    now = int(time.time() * 1000)
    removes = [_remove(a, now) for a in (old.files if old else {}).values()]
    head = [_info("WRITE"), {"protocol": old.protocol if old and old.protocol else {"minReaderVersion": 1, "minWriterVersion": 2}}, _meta(df.schema, partitions, old.meta["id"] if old else None)]
    version = old.version + 1 if old else 0
    _commit(path, version, head + removes + adds)
    return version


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of old, widened if need be, then new ones. A column that is left out or has changed its type is an error."""
    have = {f.name: f for f in new.fields}
    out = []
    for f in old.fields:
        if f.name not in have:
            raise ValueError(f"column {f.name} is missing")
        g = have.pop(f.name)
        a, b = f.dataType.typeName(), g.dataType.typeName()
        if f.dataType != g.dataType and (a, b) not in WIDER and (b, a) not in WIDER:
            raise ValueError(f"column {f.name}: {a} can't become {b}")
        out.append(T.StructField(f.name, g.dataType if (a, b) in WIDER else f.dataType, True))
    return T.StructType(out + [T.StructField(f.name, f.dataType, True) for f in have.values()])


def append(df: DataFrame, path: str, partition_by: str | list[str] | None = None, z_order: list[str] | None = None) -> int:
    if not versions(path):
        return write(df, path, partition_by, z_order)
    s = replay(path)
    asked = [partition_by] if isinstance(partition_by, str) else partition_by
    if asked is not None and list(asked) != s.partitions:
        raise ValueError(f"the table is partitioned by {s.partitions}")
    schema = merged(s.schema, df.schema)
    df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))
    adds = _write_files(df, path, s.partitions, z_order)
    head = [_info("WRITE")] + ([_meta(schema, s.partitions, s.meta["id"])] if schema != s.schema else [])
    _commit(path, s.version + 1, head + adds)
    return s.version + 1


def delete(spark: SparkSession, path: str, where: Mapping) -> int:
    """Deletes the rows that equal `where` by deletion vectors; how many they were. None: no commit. A file all of whose
    rows go keeps them marked until optimize()."""
    s = replay(path)
    fixed = {k: v for k, v in where.items() if k in s.partitions}
    files = [a for a in s.files.values() if all(_matches(a["partitionValues"].get(k), v, s.schema[k].dataType) for k, v in fixed.items())]
    if not files:
        return 0
    found = _places(spark, path, files, s.schema, s.partitions)
    for k, v in where.items():
        if k not in fixed:
            found = found.where(F.col(f"`{k}`").eqNullSafe(F.lit(v)))
    found = written(found.select("__file", "__row"), "deleted")
    touched = {r[0] for r in found.select("__file").distinct().collect()}
    own = {_full(path, a): a for a in files if _full(path, a) in touched}
    if not own:
        return 0

    def vector(key, table):  # of one file: all its marked rows
        rows = table.column("__row").to_numpy()
        return pa.table({"file": [key[0].as_py()], "data": pa.array([bitmaps.encode(rows)], pa.binary()), "n": pa.array([len(np.unique(rows))], pa.int64())})

    both = found.unionAll(_deleted(spark, path, list(own.values())))
    name = uuid.uuid4()
    now = int(time.time() * 1000)
    actions = []
    with open(os.path.join(path, f"deletion_vector_{name}.bin"), "wb") as f:
        f.write(bytes([bitmaps.VERSION]))
        for r in both.groupBy("__file").applyInArrow(vector, "file string, data binary, n long").toLocalIterator():
            a = own[r["file"]]
            v = {"storageType": "u", "pathOrInlineDv": bitmaps.z85_encode(name.bytes), "offset": f.tell(), "sizeInBytes": len(r["data"]), "cardinality": r["n"]}
            f.write(bitmaps.framed(bytes(r["data"])))
            actions += [_remove(a, now), {"add": a | {"deletionVector": v, "modificationTime": now, "dataChange": True}}]
    features = {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"], "writerFeatures": ["deletionVectors"]}
    n = found.count()
    _commit(path, s.version + 1, [_info("DELETE"), *([{"protocol": features}] if s.protocol != features else []), *actions])
    spent(found)
    return n


def changes(spark: SparkSession, path: str, since: int, until: int | None = None) -> DataFrame:
    """Rows with _change_type, _commit_version and _commit_timestamp, from each commit's cdc files or else its data changes:
    rows of added files, rows of removed ones, and rows that a file's new deletion vector marks and its former one didn't."""
    last = versions(path)[-1] if until is None else until
    s = replay(path, last)
    parts = []
    for v in range(since, last + 1):
        acts = _actions(path, v)
        stamp = next((a["commitInfo"].get("timestamp", 0) for a in acts if "commitInfo" in a), 0)
        added = {a["add"]["path"]: a["add"] for a in acts if "add" in a and a["add"].get("dataChange", True)}
        removed = {a["remove"]["path"]: a["remove"] for a in acts if "remove" in a and a["remove"].get("dataChange", True)}
        cdc = [a["cdc"] for a in acts if "cdc" in a]
        found = []
        if cdc:
            with_type = T.StructType([*s.schema.fields, T.StructField("_change_type", T.StringType())])
            found.append(_scan(spark, path, cdc, with_type, s.partitions))
        else:
            groups = {"insert": [a for p, a in added.items() if p not in removed], "delete": [a for p, a in removed.items() if p not in added]}
            found += [_scan(spark, path, g, s.schema, s.partitions).withColumn("_change_type", F.lit(k)) for k, g in groups.items() if g]
            if marked := [p for p in added if p in removed]:
                rows = _places(spark, path, [removed[p] | {"partitionValues": added[p]["partitionValues"]} for p in marked], s.schema, s.partitions)
                rows = rows.join(_deleted(spark, path, [added[p] for p in marked]), ["__file", "__row"], "left_semi")
                found.append(rows.select(*(F.col(f"`{n}`") for n in s.schema.names), F.lit("delete").alias("_change_type")))
        parts += [d.withColumns({"_commit_version": F.lit(v).cast("long"), "_commit_timestamp": F.timestamp_millis(F.lit(stamp))}) for d in found]
    if not parts:
        return _scan(spark, path, [], s.schema, s.partitions).withColumns({"_change_type": F.lit(""), "_commit_version": F.lit(0).cast("long"), "_commit_timestamp": F.timestamp_millis(F.lit(0))})
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def optimize(spark: SparkSession, path: str, z_order: list[str] | None = None, files: int = 1) -> int:
    """Rewrites the data in fewer files, as a new version that changes no rows."""
    s = replay(path)
    df = _scan(spark, path, list(s.files.values()), s.schema, s.partitions)
    df = df if z_order else df.repartition(files, *s.partitions) if s.partitions else df.coalesce(files)
    adds = _write_files(df, path, s.partitions, z_order, change=False)
    now = int(time.time() * 1000)
    _commit(path, s.version + 1, [_info("OPTIMIZE")] + [_remove(a, now, False) for a in s.files.values()] + adds)
    return s.version + 1


def vacuum(path: str, keep_history: bool = True) -> int:
    """Deletes data files and deletion vectors that no version of the log names (or, without history, that the last one
    doesn't have); how many they were."""
    live = list(replay(path).files.values())
    if keep_history:
        live += [a[k] for v in versions(path) for a in _actions(path, v) for k in ("add", "cdc", "remove") if a.get(k)]
    named = {_full(path, f) for f in live}
    named |= {os.path.abspath(os.path.join(path, bitmaps.file_name(v["pathOrInlineDv"]))) for f in live if (v := f.get("deletionVector")) and v["storageType"] == "u"}
    n = 0
    for d, dirs, names in os.walk(path):
        dirs[:] = [x for x in dirs if x != "_delta_log"]
        for f in names:
            full = os.path.abspath(os.path.join(d, f))
            if f.endswith((".parquet", ".bin")) and full not in named:
                os.unlink(full)
                n += 1
    return n
