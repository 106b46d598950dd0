"""Deletion vectors: sets of row numbers as roaring bitmaps, in the portable 64-bit layout, inline or in a file."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np

# Fixed values of the formats: the base-85 alphabet, the magic number of a vector and the cookies of a bitmap.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
MAGIC = 1681511377
PLAIN, WITH_RUNS = 12346, 12347
ARRAY_MOST, BITSET_BYTES, OFFSETS_FROM = 4096, 8192, 4
VERSION = 1


def z85_encode(data: bytes) -> str:
    out = []
    for (x,) in struct.iter_unpack(">I", data + b"\0" * (-len(data) % 4)):
        out += [ALPHABET[x // 85**i % 85] for i in (4, 3, 2, 1, 0)]
    return "".join(out)


def z85_decode(text: str) -> bytes:
    at = {c: i for i, c in enumerate(ALPHABET)}
    out = bytearray()
    for i in range(0, len(text), 5):
        x = 0
        for c in text[i : i + 5]:
            x = x * 85 + at[c]
        out += struct.pack(">I", x)
    return bytes(out)


def _encode32(low: np.ndarray) -> bytes:
    """A 32-bit bitmap of sorted distinct numbers, in containers of arrays and bitsets."""
    key = (low >> np.uint32(16)).astype(np.uint16)
    cut = np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1))
    ends = np.append(cut[1:], len(low))
    head, offsets, body = [], [], []
    at = 8 + 8 * len(cut)
    for a, b in zip(cut, ends, strict=True):
        part = (low[a:b] & np.uint32(0xFFFF)).astype("<u2")
        head.append(struct.pack("<HH", int(key[a]), b - a - 1))
        offsets.append(struct.pack("<I", at))
        if b - a <= ARRAY_MOST:
            body.append(part.tobytes())
        else:
            bits = np.zeros(BITSET_BYTES * 8, dtype=np.uint8)
            bits[part] = 1
            body.append(np.packbits(bits, bitorder="little").tobytes())
        at += len(body[-1])
    return struct.pack("<II", PLAIN, len(cut)) + b"".join(head) + b"".join(offsets) + b"".join(body)


def _decode32(data: bytes, at: int) -> tuple[np.ndarray, int]:
    (cookie,) = struct.unpack_from("<I", data, at)
    at += 4
    if cookie & 0xFFFF == WITH_RUNS:
        n = (cookie >> 16) + 1
        runs = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
    elif cookie == PLAIN:
        (n,) = struct.unpack_from("<I", data, at)
        runs = np.zeros(n, dtype=bool)
        at += 4
    else:
        raise ValueError("not a roaring bitmap")
    head = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.uint32)
    at += 4 * n
    if not runs.any() or n >= OFFSETS_FROM:
        at += 4 * n  # where each container starts; they follow one another
    out = []
    for (key, less), run in zip(head.tolist(), runs.tolist(), strict=True):
        if run:
            (m,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data, "<u2", 2 * m, at + 2).reshape(m, 2).astype(np.int64)
            at += 2 + 4 * m
            part = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs]) if m else np.zeros(0, np.int64)
        elif less < ARRAY_MOST:
            part = np.frombuffer(data, "<u2", less + 1, at)
            at += 2 * (less + 1)
        else:
            part = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, BITSET_BYTES, at), bitorder="little"))
            at += BITSET_BYTES
        out.append(part.astype(np.uint32) + np.uint32(key << 16))
    return np.concatenate(out) if out else np.zeros(0, np.uint32), at


def encode(rows: np.ndarray) -> bytes:
    rows = np.unique(rows.astype(np.uint64))
    high = rows >> np.uint64(32)
    parts = [struct.pack("<iq", MAGIC, len(np.unique(high)))]
    for h in np.unique(high):
        parts.append(struct.pack("<I", int(h)) + _encode32((rows[high == h] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
    return b"".join(parts)


def decode(data: bytes) -> np.ndarray:
    """Sorted row numbers (int64)."""
    magic, n = struct.unpack_from("<iq", data, 0)
    if magic != MAGIC:
        raise ValueError("not a deletion vector")
    at, out = 12, [np.zeros(0, np.int64)]
    for _ in range(n):
        (high,) = struct.unpack_from("<I", data, at)
        low, at = _decode32(data, at + 4)
        out.append(low.astype(np.int64) + (high << 32))
    return np.concatenate(out)


def file_name(coded: str) -> str:
    """The path, below the table, of the file that a descriptor's text names: an optional prefix and a coded UUID."""
    prefix, code = coded[:-20], coded[-20:]
    return (prefix + "/" if prefix else "") + f"deletion_vector_{uuid.UUID(bytes=z85_decode(code))}.bin"


def framed(data: bytes) -> bytes:
    """A vector as it stands in a file: size, data, checksum."""
    return struct.pack(">I", len(data)) + data + struct.pack(">I", zlib.crc32(data))


def unframed(file: bytes, offset: int, size: int) -> bytes:
    (n,) = struct.unpack_from(">I", file, offset)
    data = file[offset + 4 : offset + 4 + n]
    if n != size or struct.unpack_from(">I", file, offset + 4 + n)[0] != zlib.crc32(data):
        raise ValueError("a deletion vector is damaged")
    return data
