"""Avro binary data: values by schema, object container files, and the schema-registry envelope."""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = b"Obj\x01"
SYNC = 16


def _put_long(out: io.BytesIO, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n & ~0x7F:
        out.write(bytes([(n & 0x7F) | 0x80]))
        n >>= 7
    out.write(bytes([n]))


def _get_long(f: io.BytesIO) -> int:
    shift = n = 0
    while True:
        b = f.read(1)[0]
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _named(schema, names: dict):
    if isinstance(schema, dict) and schema.get("name"):
        names[schema["name"]] = schema
    return names.get(schema, schema) if isinstance(schema, str) else schema


def put(out: io.BytesIO, schema, x, names: dict | None = None) -> None:
    names = {} if names is None else names
    schema = _named(schema, names)
    if isinstance(schema, list):
        i = next((i for i, s in enumerate(schema) if (s == "null") == (x is None)), None)
        if i is None:
            raise ValueError("no branch of the union fits")
        _put_long(out, i)
        return put(out, schema[i], x, names)
    t = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(t, (dict, list)):
        return put(out, t, x, names)
    if t == "null":
        return None
    if t == "boolean":
        out.write(b"\x01" if x else b"\x00")
    elif t in ("int", "long"):
        _put_long(out, int(x))
    elif t in ("float", "double"):
        out.write(struct.pack("<f" if t == "float" else "<d", x))
    elif t in ("bytes", "string"):
        data = x.encode() if isinstance(x, str) else bytes(x)
        _put_long(out, len(data))
        out.write(data)
    elif t == "fixed":
        out.write(bytes(x))
    elif t == "enum":
        _put_long(out, schema["symbols"].index(x))
    elif t == "record":
        for f in schema["fields"]:
            put(out, f["type"], x.get(f["name"], f.get("default")), names)
    elif t in ("array", "map"):
        items = list(x.items() if t == "map" else x)
        if items:
            _put_long(out, len(items))
            for i in items:
                if t == "map":
                    put(out, "string", i[0], names)
                put(out, schema["items" if t == "array" else "values"], i[1] if t == "map" else i, names)
        _put_long(out, 0)
    else:
        raise ValueError(f"no type {t!r}")
    return None


def get(f: io.BytesIO, schema, names: dict | None = None):
    names = {} if names is None else names
    schema = _named(schema, names)
    if isinstance(schema, list):
        return get(f, schema[_get_long(f)], names)
    t = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(t, (dict, list)):
        return get(f, t, names)
    if t == "null":
        return None
    if t == "boolean":
        return f.read(1) == b"\x01"
    if t in ("int", "long"):
        return _get_long(f)
    if t in ("float", "double"):
        return struct.unpack("<f" if t == "float" else "<d", f.read(4 if t == "float" else 8))[0]
    if t in ("bytes", "string"):
        data = f.read(_get_long(f))
        return data.decode() if t == "string" else data
    if t == "fixed":
        return f.read(schema["size"])
    if t == "enum":
        return schema["symbols"][_get_long(f)]
    if t == "record":
        return {x["name"]: get(f, x["type"], names) for x in schema["fields"]}
    if t in ("array", "map"):
        out: list = []
        while n := _get_long(f):
            if n < 0:
                n = -n
                _get_long(f)
            for _ in range(n):
                out.append((get(f, "string", names), get(f, schema["values"], names)) if t == "map" else get(f, schema["items"], names))
        return dict(out) if t == "map" else out
    raise ValueError(f"no type {t!r}")


def write_file(path: str, schema: dict, rows: list[dict], metadata: dict[str, str] | None = None, codec: str = "deflate") -> None:
    out = io.BytesIO()
    out.write(MAGIC)
    put(out, {"type": "map", "values": "bytes"}, {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode(), **{k: v.encode() for k, v in (metadata or {}).items()}})
    sync = os.urandom(SYNC)
    out.write(sync)
    if rows:
        block = io.BytesIO()
        names: dict = {}
        for r in rows:
            put(block, schema, r, names)
        data = block.getvalue()
        if codec == "deflate":
            c = zlib.compressobj(wbits=-15)
            data = c.compress(data) + c.flush()
        _put_long(out, len(rows))
        _put_long(out, len(data))
        out.write(data + sync)
    with open(path, "wb") as f:
        f.write(out.getvalue())


def read_file(path: str) -> Iterator[dict]:
    with open(path, "rb") as h:
        f = io.BytesIO(h.read())
    if f.read(4) != MAGIC:
        raise ValueError(f"{path} is no Avro file")
    meta = get(f, {"type": "map", "values": "bytes"})
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    f.read(SYNC)
    while f.tell() < len(f.getbuffer()):
        n, size = _get_long(f), _get_long(f)
        data = f.read(size)
        if codec == "deflate":
            data = zlib.decompress(data, -15)
        elif codec != "null":
            raise ValueError(f"codec {codec}")
        f.read(SYNC)
        block, names = io.BytesIO(data), {}
        for _ in range(n):
            yield get(block, schema, names)


def encode(x: dict, schema: dict, schema_id: int) -> bytes:
    out = io.BytesIO()
    out.write(b"\0" + schema_id.to_bytes(4, "big"))
    put(out, schema, x)
    return out.getvalue()


def decode(data: bytes, schema: dict) -> dict:
    if data[:1] != b"\0":
        raise ValueError("no schema-registry envelope")
    return get(io.BytesIO(data[5:]), schema)


def decoded(payload: Column, schema: dict) -> Column:
    """JSON text of each enveloped payload."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: None if b is None else json.dumps(decode(bytes(b), schema), default=str))

    return run(payload)
