"""Benchmark decontamination by greedy string tiling.

Words (runs of letters and digits, A-Z as a-z) of documents and benchmark items are hashed; windows
of `SEED` words that a document shares with an item are the seeds. Neighbouring seeds on a diagonal
join to maximal common runs. Tiling then marks the longest run whose words are all unmarked, in
document and item, again and again (a run that a mark has cut is tried again with what is left of
it), until none of `SEED` words remains. An item leaks into a document if the tiles cover at least
`COVERAGE` of the item's words; as tiles may lie in any order, reordered passages count too.
Items shorter than a seed leak where all their words stand in a row.

The items' windows go to all executors in blocks of at most `block_words` words, so what is sent is
bounded; each block meets every document. Window hashes are found by a bitmap and then by binary
search; equal hashes of 64 bits count as equal words.

Defined results: null or empty texts and items leak nothing; a null item_id or doc_id stays null;
repeated items each get their rows and repeated documents too; ties between runs go to the leftmost
in the document, then in the item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import PUNCT, U, Words, mix, pieces

SEED, COVERAGE = 5, 0.6
BLOCK_WORDS = 1 << 20
_FILTER_BITS = 22


def _window(words: np.ndarray, k: int) -> np.ndarray:
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    x = words[:m].copy()
    for j in range(1, k):
        x = x * U(0xD6E8FEB86659FD93) + words[j : j + m]
    return mix(x)


class Items:
    """Hashed words of a block of items, and their windows in order of hash."""

    def __init__(self, texts: list[str | None], ids: list[int | None], seed: int):
        w = Words(pa.array(texts, pa.string()), PUNCT)
        self.ids, self.seed, self.words = ids, seed, [w.hash[a:b] for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
        self.sizes = {}
        for size in sorted({min(seed, len(x)) for x in self.words if len(x)}):  # shorter items have windows of their own size
            h, item, at = [], [], []
            for i, x in enumerate(self.words):
                if min(seed, len(x)) == size:
                    g = _window(x, size)
                    h.append(g), item.append(np.full(len(g), i)), at.append(np.arange(len(g)))
            h, item, at = np.concatenate(h), np.concatenate(item), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[(h >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.sizes[size] = (h[order], item[order], at[order], bits)


def tile(doc: np.ndarray, item: np.ndarray, seeds: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, words) from seeds (rows of doc and item places of equal k-word windows)."""
    diagonal = seeds[:, 0] - seeds[:, 1]
    s = seeds[np.lexsort((seeds[:, 0], diagonal))]
    d = s[:, 0] - s[:, 1]
    cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(s[:, 0]) != 1)) + 1
    heap = [(-int(b - a + k - 1), int(s[a, 0]), int(s[a, 1])) for a, b in zip([0, *cut], [*cut, len(s)], strict=True)]
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item = np.zeros(len(item), dtype=bool)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = [not used_item[q + i] and p + i not in used_doc for i in range(n)]
        if all(free):
            tiles.append((p, q, n))
            used_item[q : q + n] = True
            used_doc.update(range(p, p + n))
            continue
        i = 0
        while i < n:  # what marks have left of it
            j = i
            while j < n and free[j]:
                j += 1
            if j - i >= k:
                heapq.heappush(heap, (-(j - i), p + i, q + i))
            i = j + 1
    return tiles


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, item_words, longest): every item that leaks into a document."""
    schema = "doc_id long, item_id long, n_tiles int, covered int, item_words int, longest int"
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = None
    block: list = []
    words = 0

    def against(rows) -> DataFrame:
        items = Items([r["text"] for r in rows], [r["item_id"] for r in rows], seed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                w = Words(piece.column("text"), PUNCT)
                found: list[tuple] = []
                for k, (hashes, of_item, at, bits) in items.sizes.items():
                    g, ok = w.grams(k) if k > 1 else (mix(w.hash), np.ones(len(w.hash), dtype=bool))
                    near = np.flatnonzero(ok & bits[(g >> U(64 - _FILTER_BITS)).astype(np.int64)])
                    lo, hi = np.searchsorted(hashes, g[near], "left"), np.searchsorted(hashes, g[near], "right")
                    hit = hi > lo
                    near, lo, hi = near[hit], lo[hit], hi[hit]
                    if not len(near):
                        continue
                    n = hi - lo
                    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    place, entry = np.repeat(near, n), np.repeat(lo, n) + rank
                    doc = np.searchsorted(w.at, place, "right") - 1
                    order = np.lexsort((of_item[entry], doc))
                    doc, item, place, entry = doc[order], of_item[entry][order], place[order], entry[order]
                    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
                    for x, y in zip([0, *cut], [*cut, len(doc)], strict=True):
                        i, d = int(item[x]), int(doc[x])
                        words_of = items.words[i]
                        # the seeds' union bounds what tiles can cover
                        m = np.zeros(len(words_of), dtype=bool)
                        for j in range(k):
                            m[at[entry[x:y]] + j] = True
                        if m.sum() < coverage * len(words_of):
                            continue
                        tiles = tile(w.hash[w.at[d] : w.at[d + 1]], words_of, np.column_stack([place[x:y] - w.at[d], at[entry[x:y]]]), k)
                        total = sum(t[2] for t in tiles)
                        if total >= coverage * len(words_of):
                            found.append((d, items.ids[i], len(tiles), total, len(words_of), max(t[2] for t in tiles)))
                found.sort(key=lambda r: r[0])
                ids = piece.column("doc_id").cast(pa.int64()).take(pa.array([r[0] for r in found], pa.int64()))
                rest = [pa.array([r[c] for r in found], pa.int64() if c == 1 else pa.int32()) for c in range(1, 6)]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "n_tiles", "covered", "item_words", "longest"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    for row in b.where("text is not null").toLocalIterator():  # one partition of the benchmark at a time
        block.append(row)
        words += len(row["text"]) // 2 + 1
        if words >= block_words:
            out = against(block) if out is None else out.unionAll(against(block))
            block, words = [], 0
    if block or out is None:
        out = against(block) if out is None else out.unionAll(against(block))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those into which an item leaks, row by row: rows that repeat an id are judged by their own texts."""
    row = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    bad = leaks(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(bad, row == F.col("__leak"), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
