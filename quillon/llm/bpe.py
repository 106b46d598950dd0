"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Two tiers: a minimal perfect hash (hash and displace) resolves a pre-token that is a whole entry of
the vocabulary; any other is merged, lowest rank and then leftmost first, with a heap over a linked
list of its bytes. A worker remembers recent pre-tokens, up to a fixed number and length.

Defined results: a null text is encoded as an empty one; special tokens have no meaning here;
documents are encoded row by row, so repeated rows, null ids and further columns don't matter
(an input column named like an output is replaced).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Half the pre-tokens that a process remembers, and the length up to which it does.
REMEMBERED, LONGEST = 1 << 18, 64
_M = (1 << 64) - 1


def _hash(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")


def _place(h: int, seed: int, n: int) -> int:
    h = ((h ^ seed) * 0x9E3779B97F4A7C15) & _M
    return (h ^ (h >> 29)) % n


class PerfectHash:
    """Minimal perfect hash of n keys: n slots, and a seed (or, negative, the slot itself) for each of n / 4 buckets."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.seeds = [0] * max(1, n // 4)
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = _hash(k)
            buckets.setdefault(h % len(self.seeds), []).append((h, i))
        free = [True] * n
        spare = n - 1
        for b, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                while not free[spare]:
                    spare -= 1
                at, self.seeds[b] = [spare], -spare - 1
            else:
                seed = 1
                while True:
                    at = [_place(h, seed, n) for h, _ in members]
                    if all(free[a] for a in at) and len({*at}) == len(at):
                        break
                    seed += 1
                self.seeds[b] = seed
            for a, (_, i) in zip(at, members, strict=True):
                free[a], self.keys[a], self.values[a] = False, keys[i], i

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = _hash(key)
        seed = self.seeds[h % len(self.seeds)]
        at = -seed - 1 if seed < 0 else _place(h, seed, self.n)
        return self.values[at] if self.keys[at] == key else None


#: The tokenizer that this process has unpacked last: a worker's tasks share it, with the pre-tokens that it remembers.
_LAST: dict[str, Tokenizer] = {}


def _unpacked(name: str, data: bytes) -> Tokenizer:
    if name not in _LAST:
        t = Tokenizer.__new__(Tokenizer)
        t.__dict__.update(pickle.loads(data))
        _LAST.clear()
        _LAST[name] = t
    return _LAST[name]


class Tokenizer:
    """entries: the vocabulary in the order of its ranks (0, 1, ...), all single bytes among them. pattern: cuts a text into pre-tokens."""

    def __init__(self, entries: list[bytes], pattern: str):
        self.entries, self.pattern = entries, pattern
        self.whole = PerfectHash(entries)
        rank = {e: i for i, e in enumerate(entries)}
        self.bytes = [rank[bytes([i])] for i in range(256)]
        #: rank of the joined entry by the ranks of two neighbours
        self.joined = {(a << 32) | b: i for i, e in enumerate(entries) for k in range(1, len(e)) if (a := rank.get(e[:k])) is not None and (b := rank.get(e[k:])) is not None}
        self._find = self._packed = None

    def __reduce__(self):
        if self._packed is None:
            data = pickle.dumps(self.__dict__ | {"_find": None, "_known": None, "_before": None})
            self._packed = (hashlib.sha256(data).hexdigest(), data)
        return _unpacked, self._packed

    @classmethod
    def load(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as f:
            ranked = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ranks are not 0, 1, 2, ...")
        return cls([t for _, t in ranked], pattern)

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.bytes[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joined = self.joined.get
        heap = [(r, i) for i in range(n - 1) if (r := joined(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or joined(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := joined(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            p = before[i]
            if p >= 0 and (x := joined(ids[p] << 32 | r)) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8")
        whole = self.whole.get(raw)
        return (whole,) if whole is not None else tuple(self.merge(raw))

    def encode(self, text: str) -> list[int]:
        if self._find is None:
            import regex

            self._find, self._known, self._before = regex.compile(self.pattern).findall, {}, {}
        known, out = self._known, []
        for t in self._find(text):
            ids = known.get(t)
            if ids is None:
                ids = self._before.get(t) or self.piece(t)
                if len(t) <= LONGEST:
                    if len(known) >= REMEMBERED:  # what is met again comes over from the former ones
                        self._before, self._known = known, {}
                        known = self._known
                    known[t] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        e = self.entries
        return b"".join([e[i] for i in ids])


def public_tokenizer(path: str | None = None) -> Tokenizer:
    import public_tokenizers as P

    # the pattern's \s is White_Space; here it is spelled out, as libraries differ on U+001C to U+001F
    space = r"\t-\r\x20\x85\xa0  -     　"
    pattern = P.PATTERN.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
    return Tokenizer.load(path or P.path(VOCABULARY), pattern)


def encoded(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """docs with n_tokens (long), ids (array of int), and the decoded bytes of these ids."""
    out = ("n_tokens", "ids", "decoded")
    kept = [f for f in docs.schema.fields if f.name.lower() not in out]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    at = [f.name for f in docs.schema.fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._text import pieces

        for b in pieces((x.rename_columns([str(i) for i in range(x.num_columns)]) for x in batches), str(at)):
            ids = [tokenizer.encode(x or "") for x in b.column(at).to_pylist()]
            keep = [b.column(i) for i, f in enumerate(docs_fields) if f not in out]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([tokenizer.decode(x) for x in ids], pa.binary())], names=schema_names)

    docs_fields, schema_names = [f.name.lower() for f in docs.schema.fields], schema.names
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encoded() gives, hashed beside it, so that ids needn't leave the worker."""
    names = [str(i) for i in range(len(tokenizer.entries))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._text import pieces

        for b in pieces(batches):
            ids = [tokenizer.encode(x or "") for x in b.column(1).to_pylist()]
            of_ids = [hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest() for x in ids]
            of_text = [hashlib.sha256(tokenizer.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
