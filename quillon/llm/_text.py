"""Vectorised text primitives shared by the operators of this subpackage.

Arrow string columns are cut into pieces of bounded size and handled as numpy byte arrays:
no Python object per word. Nulls count as empty texts. A piece holds whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Separator tables by byte. White space: 0x20, 0x09-0x0D. Words of letters and digits: every other ASCII byte.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
PUNCT = np.zeros(256, dtype=bool)
PUNCT[:0x30] = PUNCT[0x3A:0x61] = PUNCT[0x7B:0x80] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POW = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype=U))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and bytes of a string column."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = a.buffers()
    off = np.frombuffer(at, dtype=np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `most` bytes of text, or one document if that is longer."""
    for b in batches:
        if not b.num_rows:
            continue
        off, _ = buffers(b.column(b.schema.get_field_index(text)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j


class Words:
    """Words of the texts of a piece: 64-bit hashes, and each text's first word in `at` (n + 1 entries)."""

    def __init__(self, column: pa.Array, sep: np.ndarray = SPACE):
        off, raw = buffers(column)
        n = len(raw)
        low = _LOWER[raw]
        inside = ~sep[low]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = off[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            first[edge] = inside[edge]
            last[edge - 1] = inside[edge - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, off)
        self.off, self.raw, self.low, self.n_texts = off, raw, low, len(off) - 1
        if len(self.starts):
            from_ = np.zeros(n, dtype=np.int64)
            from_[self.starts] = self.starts
            rel = (np.arange(n) - np.maximum.accumulate(from_)) & 0xFFFF
            value = np.where(inside, _BYTE[low], U(0)) * _POW[rel]
            self.hash = mix(np.add.reduceat(value, self.starts) + (self.ends - self.starts).astype(U))
        else:
            self.hash = np.zeros(0, dtype=U)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k-word window at each word, and whether the window lies within one text."""
        n = len(self.hash)
        ok = np.zeros(n, dtype=bool)
        h = np.zeros(n, dtype=U)
        m = n - k + 1
        if m > 0:
            x = self.hash[:m].copy()
            for j in range(1, k):
                x = x * U(0xD6E8FEB86659FD93) + self.hash[j : j + m]
            h[:m] = mix(x)
            end = np.repeat(self.at[1:], np.diff(self.at))
            ok[:m] = np.arange(m) + k <= end[:m]
        return h, ok

    def shingles(self, k: int) -> list[np.ndarray]:
        """Sorted distinct k-word shingles of each text; all words of a shorter text are one shingle."""
        h, ok = self.grams(k)
        out = []
        for i in range(self.n_texts):
            a, b = self.at[i], self.at[i + 1]
            if b - a >= k:
                out.append(np.unique(h[a : b - k + 1]))
            elif b > a:
                x = U(b - a)
                with np.errstate(over="ignore"):
                    for w in self.hash[a:b]:
                        x = x * U(0xD6E8FEB86659FD93) + w
                out.append(mix(np.array([x ^ U(0xA5A5A5A5A5A5A5A5)], dtype=U)))
            else:
                out.append(np.zeros(0, dtype=U))
        return out
