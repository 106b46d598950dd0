"""N-gram Jaccard join: all documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

1. Documents with equal sets form a class; only classes are compared.
2. A sketch, sized by the number of shingles up to a bound, counts all shingles of the corpus; a set's
   shingles are ordered from rare to common by it (ties by hash), one order for all.
3. A class sends only its prefix: n - ceil(0.8 n) + 1 shingles. Classes that meet in a prefix
   shingle and pass the length, index-prefix and positional filters are candidates.
   In a bucket of over `large` classes only the star around a pivot is compared at first.
4. Suffix filter: each class has a bitmap of about n bits, in which each shingle flips the bit of its hash;
   the bits in which two bitmaps differ bound the symmetric difference from below. Only pairs that pass
   are verified, once each, on whole sets.
5. Components of the links. Classes that large buckets connect and that are still in different
   components are then compared across components, whole sets in blocks, a task for each pair of blocks, and
   only links that join components are handed on: no link that could join components is lost.

Defined results: A-Z count as a-z; a text without words has an empty set and links with nothing;
a text of fewer than five words is one shingle; a null id can't be named, so its component is null;
rows that repeat an id each get their own n_shingles and the id's component, as the id joins the classes that it has
(but for a text without words, whose component is its id).
Shingles and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runs import all_pairs, runs, table_of
from ._stage import bloom, components, in_bloom, spent, written
from ._text import U, Words, mix, pieces

K = 5
T_NUM, T_DEN = 4, 5  # similarity 4/5
#: Most bins of the frequency sketch (one byte each in what is sent) and bins in a chunk; shingles for each bin below that.
BINS, CHUNK, LOAD = 1 << 22, 1 << 16, 32
LARGE, BLOCK = 64, 512
#: Columns of a 0/1 matrix that is multiplied at once.
WIDTH = 4096


def _i64(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if isinstance(x, np.ndarray) and x.dtype == U else x, type=pa.int64())


def _key(s: np.ndarray) -> int:
    a = int(mix(mix(s * U(0x9E3779B97F4A7C15) + U(1)) + mix(s)).sum(dtype=U) + U(len(s)))
    return a - (a >> 63 << 64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits (packed in bytes) that the shingles' hashes flip; at least 64, about as many as there are shingles."""
    n = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s) & U(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Least size of the symmetric difference, by bitmaps. The longer one is folded to the size of the other."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in pieces(batches):
        yield b, Words(b.column("text")).shingles(k)


def signatures(docs: DataFrame, k: int = K, th: bool = False) -> DataFrame:
    """(doc_id, n, k1, bits) of every document: the size of its set, a hash of it, and its bitmap; with th, also a hash of the text."""
    more = [F.xxhash64("text").alias("th")] if th else []

    def run(batches):
        for b, sets in _sets(batches, k):
            bits = [bitmap(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.int64()), pa.array(bits, pa.binary()), *b.columns[2:]], names=["doc_id", "n", "k1", "bits", *["th"] * th])

    return docs.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, n long, k1 long, bits binary" + ", th long" * th)


def n_bins(shingles: int) -> int:
    return min(BINS, max(CHUNK, 1 << max(0, shingles // LOAD).bit_length()))


def frequency_ranks(docs: DataFrame, k: int = K, bins: int = BINS, column: str = "text", sets_of=_sets) -> np.ndarray:
    """One byte a bin: eight times the base-2 logarithm of how many shingles of the corpus fall into it. sets_of: from batches
    of the column to its sets."""

    def partial(batches):
        total = np.zeros(bins, dtype=np.uint32)
        for _, sets in sets_of(batches, k):
            np.add.at(total, (np.concatenate(sets) % U(bins)).astype(np.int64), 1)
        at = [i for i in range(0, bins, CHUNK) if total[i : i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i in at], pa.int32()), pa.array([zlib.compress(total[i : i + CHUNK].tobytes(), 1) for i in at], pa.binary())], names=["chunk", "counts"])

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint32).astype(np.int64)
                sums[c] = sums[c] + got if c in sums else got
        out = {c: np.where(v > 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(v, 1)))), 0).astype(np.uint8).tobytes() for c, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.binary())], names=["chunk", "ranks"])

    parts = docs.select(column).mapInArrow(partial, "chunk int, counts binary")
    rows = parts.repartition(max(1, bins // CHUNK), "chunk").mapInArrow(merged, "chunk int, ranks binary").collect()  # `bins` bytes
    out = np.zeros(bins, dtype=np.uint8)
    for r in rows:
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + CHUNK] = np.frombuffer(r["ranks"], dtype=np.uint8)
    return out


def need(a, b):
    """Least overlap of sets of sizes a and b at the similarity: ceil(t / (1 + t) * (a + b))."""
    return -(-(T_NUM * (a + b)) // (T_NUM + T_DEN))


def postings(docs: DataFrame, ranks: np.ndarray, k: int = K) -> DataFrame:
    """(h, k1, n, pos): the prefix shingles of each class, once a task."""
    bins = len(ranks)

    def run(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            h, k1, n, pos = [], [], [], []
            for s in sets:
                if not len(s) or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                p = len(s) - -(-(T_NUM * len(s)) // T_DEN) + 1
                r = ranks[(s % U(bins)).astype(np.int64)]
                h.append(s[np.argsort(r, kind="stable")[:p]])
                k1.append(np.full(p, key, dtype=np.int64))
                n.append(np.full(p, len(s), dtype=np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if h:
                yield pa.RecordBatch.from_arrays([_i64(np.concatenate(h)), pa.array(np.concatenate(k1)), pa.array(np.concatenate(n)), pa.array(np.concatenate(pos))], names=["h", "k1", "n", "pos"])

    return docs.select("text").mapInArrow(run, "h long, k1 long, n int, pos int")


def _passes(na, pa_, nb, pb):
    """Length, index-prefix and positional filters; a is the shorter side (arrays, elementwise)."""
    least = need(na, nb)
    index = na - -(-(2 * T_NUM * na) // (T_NUM + T_DEN)) + 1
    return (na * T_DEN >= nb * T_NUM) & (pa_ < index) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= least)


def candidates(posts: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b, h, na, pa, nb, pb): pairs of class keys. h is null in small buckets, whose pairs are all compared.

    In a large bucket each row b comes once, with its pivot a (b itself at a pivot), whether or not the pair passes."""

    def run(batches):
        held: list[np.ndarray] = []
        pivot = None

        def flush():
            x = np.unique(np.concatenate(held), axis=0)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2], mask=x[:, 7] == 0), *(pa.array(x[:, i]) for i in range(3, 7))], names=["a", "b", "h", "na", "pa", "nb", "pb"])

        for what, rows, starts in runs((table_of(b, 4) for b in batches), large):
            if what == "short":
                for x, y in all_pairs(rows, starts):
                    ok = (x[:, 1] != y[:, 1]) & _passes(x[:, 2], x[:, 3], y[:, 2], y[:, 3])
                    if ok.any():
                        out = np.zeros((int(ok.sum()), 8), dtype=np.int64)
                        out[:, 0], out[:, 1] = np.minimum(x[ok, 1], y[ok, 1]), np.maximum(x[ok, 1], y[ok, 1])
                        held.append(out)
            else:
                if what == "long":
                    pivot = None
                    if rows[:, 1].min() == rows[:, 1].max():
                        rows = rows[:1]
                out = np.empty((len(rows), 8), dtype=np.int64)
                i = 0
                while i < len(rows):
                    before = None
                    if pivot is None or pivot[2] * T_DEN < rows[i, 2] * T_NUM:
                        before, pivot = pivot, rows[i].copy()
                    j = max(i + 1, int(np.searchsorted(rows[:, 2] * T_NUM > pivot[2] * T_DEN, True)))
                    out[i:j, 0] = pivot[1]
                    out[i:j, 3], out[i:j, 4] = pivot[2], pivot[3]
                    if before is not None:  # too short to be similar, but of one cluster
                        out[i, 0], out[i, 3], out[i, 4] = before[1], before[2], before[3]
                    i = j
                out[:, 1], out[:, 2], out[:, 5], out[:, 6], out[:, 7] = rows[:, 1], rows[:, 0], rows[:, 2], rows[:, 3], 1
                held.append(out)
            if sum(map(len, held)) > 1 << 16:
                yield flush()
        if held:
            yield flush()

    return posts.repartition("h").sortWithinPartitions("h", "n", "k1").mapInArrow(run, "a long, b long, h long, na long, pa long, nb long, pb long")


def set_table(docs: DataFrame, keep: np.ndarray, k: int = K) -> DataFrame:
    """(k1, members) of the classes that may be among those that `keep` was made of, once a task."""

    def run(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            keys = np.array([_key(s) for s in sets], dtype=np.int64)
            at = []
            for i in np.flatnonzero(in_bloom(keep, keys)).tolist():
                if len(sets[i]) and int(keys[i]) not in seen:
                    seen.add(int(keys[i]))
                    at.append(i)
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["k1", "members"])

    return docs.select("text").mapInArrow(run, "k1 long, members binary")


def near(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter; sig: (k1, n, bits), each class once."""

    def run(batches):
        for b in batches:
            c = [b.column(i).to_pylist() for i in range(6)]
            got = []
            for p, q, na, nb, x, y in zip(*c, strict=True):
                if differing(np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)) <= na + nb - 2 * need(na, nb):
                    got.append((p, q))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([q for _, q in got], pa.int64())], names=["a", "b"])

    both = pairs.join(sig.select(F.col("k1").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    both = both.join(sig.select(F.col("k1").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sorted sets reach the similarity. The suffix filter first bounds the overlap by the parts between pivots."""
    least = need(len(x), len(y))
    if min(len(x), len(y)) < least:
        return False
    pivots = y[len(y) // 8 :: max(1, len(y) // 8)]
    bx, by = np.searchsorted(x, pivots), np.searchsorted(y, pivots)
    if np.minimum(np.diff(bx, prepend=0, append=len(x)), np.diff(by, prepend=0, append=len(y))).sum() < least:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= least


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs of classes that reach the similarity, each compared once."""

    def run(batches):
        for b in batches:
            got = [(p, q) for p, q, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True) if similar(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([q for _, q in got], pa.int64())], names=["a", "b"])

    both = pairs.join(sets.select(F.col("k1").alias("a"), F.col("members").alias("ma")), "a")
    both = both.join(sets.select(F.col("k1").alias("b"), F.col("members").alias("mb")), "b")
    return both.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Matrix of how many members each set of x shares with each of y: products of 0/1 matrices, some columns at a time."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    names = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    both = np.zeros((len(x), len(y)), dtype=np.float32)

    def entries(sets, sizes):
        v = np.concatenate(sets)
        at = np.searchsorted(names, v)
        ok = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == v) if len(names) else np.zeros(len(v), dtype=bool)
        row = np.repeat(np.arange(len(sets)), sizes)[ok]
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], row[order]

    (cx, rx), (cy, ry) = entries(x, nx), entries(y, ny)
    for lo in range(0, len(names), WIDTH):
        part = []
        for c, r, n in ((cx, rx, len(x)), (cy, ry, len(y))):
            s, e = np.searchsorted(c, lo), np.searchsorted(c, lo + WIDTH)
            m = np.zeros((n, WIDTH), dtype=np.float32)
            m[r[s:e], c[s:e] - lo] = 1
            part.append(m)
        both += part[0] @ part[1].T
    return both


def links_between(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Matrix of which sets of x reach the similarity with which of y."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    return overlaps(x, y) >= need(nx[:, None], ny[None, :])


def unsettled(starred: DataFrame, roots: DataFrame) -> DataFrame:
    """(k1, cluster, label, most): the classes of clusters, which large buckets connect, that are in two or more components so far.

    label: the class's component; most: whether it is the one with the most classes of the cluster."""
    d = components(starred.select("a", "b")).select(F.col("node").alias("k1"), F.col("component").alias("cluster"))
    d = d.join(roots.select(F.col("node").alias("k1"), F.col("component").alias("label")), "k1", "left").withColumn("label", F.coalesce("label", "k1"))
    size = d.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("m"))
    top = size.groupBy("cluster").agg(F.max_by("label", F.struct("m", -F.col("label").cast("decimal(20,0)"))).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    return d.join(top, "cluster").select("k1", "cluster", "label", (F.col("label") == F.col("top")).alias("most"))


def rest_of_large(classes: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links of classes (as unsettled() gives them) that join components of one cluster.

    Each class outside its cluster's largest component is compared with all classes of the cluster, in blocks: a task for
    each pair of blocks. Only links that join components come out, at most one fewer than there are labels in the two blocks."""
    parts = classes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nr"), F.ceil(F.sum((~F.col("most")).cast("long")) / block).cast("int").alias("nl"))
    d = classes.join(sets, "k1").join(parts, "cluster")
    own = F.xxhash64("k1")
    left = d.where("not most").select("cluster", F.pmod(own, F.col("nl")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), F.lit(True).alias("left"), "k1", "label", "members")
    right = d.select("cluster", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), F.pmod(own, F.col("nr")).cast("int").alias("j"), F.lit(False).alias("left"), "k1", "label", "members")

    def run(_, table):
        left = table.column("left").to_numpy()
        key, label = table.column("k1").to_numpy(), table.column("label").to_numpy()
        members = [np.frombuffer(m, dtype=U) for m in table.column("members").to_pylist()]
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        found = []
        if len(a) and len(b):
            linked = links_between([members[i] for i in a], [members[i] for i in b]) & (label[a][:, None] != label[b][None, :])
            root: dict[int, int] = {}

            def top(v):
                while root.get(v, v) != v:
                    v = root[v]
                return v

            for p, q in zip(*np.nonzero(linked), strict=True):
                u, v = top(label[a[p]]), top(label[b[q]])
                if u != v:
                    root[max(u, v)] = min(u, v)
                    found.append((int(key[a[p]]), int(key[b[q]])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    # dealt by all three: dealt by the cluster alone, all its blocks would be in one task
    return left.unionAll(right).repartition("cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def linked(docs: DataFrame, sig: DataFrame, k: int = K, large: int = LARGE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) of the classes of docs, as far as components need them, and (node, component) by them.
    docs: (text, ...); sig: (k1, n, bits, ...) of their rows."""
    named = sig.where("n > 0")
    total = sig.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranks = frequency_ranks(docs, k, n_bins(total))
    found = written(candidates(postings(docs, ranks, k), large), "candidates")
    small = found.where("h is null").select("a", "b")
    passes = "a <> b and na * 5 >= nb * 4 and pa < na - ceil(8 * na / 9) + 1 and 1 + least(na - pa - 1, nb - pb - 1) >= ceil(4 * (na + nb) / 9)"
    starred = found.where("h is not null")
    star = starred.where(passes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nodes = small.union(star).select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    bits = named.join(nodes, "k1", "left_semi").groupBy("k1").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    pairs = written(near(small.union(star).distinct(), bits), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    sets = written(set_table(docs, bloom(nodes), k).join(nodes, "k1", "left_semi").dropDuplicates(["k1"]), "sets")
    edges = written(verified(pairs, sets).distinct(), "edges")
    spent(sets, pairs)
    roots = components(edges)
    if not starred.isEmpty():
        classes = written(unsettled(starred, roots), "unsettled")
        if not classes.isEmpty():
            nodes = classes.select("k1")
            sets = written(set_table(docs, bloom(nodes), k).join(nodes, "k1", "left_semi").dropDuplicates(["k1"]), "sets")
            more = written(rest_of_large(classes, sets, block), "edges")
            spent(sets)
            if not more.isEmpty():
                edges = edges.union(more)
                roots = components(edges)
    spent(found)
    return edges, roots


def jaccard_components(docs: DataFrame, k: int = K, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = written(signatures(docs, k), "signatures")
    named = sig.where("doc_id is not null and n > 0")
    edges, roots = linked(docs.where("doc_id is not null"), named, k, large, block)
    # an id joins the classes that it has
    several = named.groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("z")).where("a <> z").select("doc_id", "a")
    same = written(named.join(several, "doc_id").where("k1 <> a").select("a", F.col("k1").alias("b")).distinct(), "same")
    if not same.isEmpty():
        roots = components(edges.union(same))
    least = named.groupBy("k1").agg(F.min("doc_id").alias("id")).join(roots.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    ids = least.groupBy("component").agg(F.min("id").alias("component_id"))
    out = sig.join(least.join(ids, "component").select("k1", "component_id"), "k1", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = K, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near duplicates left: the one of the least id (null ids last), then of the least
    hash of its text; of rows with equal ids and texts the one of the least hash of all columns. Rows are judged by
    their texts alone: an id that repeats with other texts is not a duplicate. Texts without words all stay."""
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")]
    slim = docs.select("doc_id", "text")
    sig = written(signatures(slim, k, th=True), "signatures")
    _, roots = linked(slim, sig, k, large, block)
    group = F.coalesce("component", "k1").alias("g")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    best = sig.where("n > 0").groupBy("k1").agg(F.min(row).alias("row")).join(roots.withColumnRenamed("node", "k1"), "k1", "left")
    best = best.groupBy(group).agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("__id"), F.col("row.th").alias("__th"))
    mark = docs.withColumns({"__key": keys[0], "__hash": keys[1]})
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = mark.where(~blank).join(best, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = kept.groupBy("__key", "__hash").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return one.unionByName(docs.where(blank))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
