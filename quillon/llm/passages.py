"""Near-duplicate passages by compact windows.

A document's tokens are its word 5-grams. For each of `FUNCTIONS` hash functions, the compact windows
of at least `LENGTH` tokens are the (l, c, r) where the token at c has the least hash of l..r and
neither end can move out: all subsequences around c within l..r share c's min-hash. The centres are
the minima of sliding windows; a Cartesian tree over the centres (whose hashes include every smaller
neighbour) gives l and r. A document has about 2 n / LENGTH of them for each function.

Windows of different documents with one function and one min-hash meet in a bucket, in which all pairs are taken
up to `PIVOT` windows. For each pair of documents the rectangles (positions around the two centres) of all functions
are joined by their intervals along the diagonal: where at least `ENOUGH` functions agree is a candidate passage.
Candidates are verified on the token sequences: the passage pair is grown over the joint extent and kept if the
Jaccard similarity of its token sets is 0.8 or more.

A bucket of more windows is crowded and makes no pairs. What it would have paired lies within regions: the stretches of a
document of which some sequence of `LENGTH` tokens has its min-hash in a crowded bucket. Regions are compared without
hashing by chance (see regions(), prefixes()):
1. Equal regions are a class; each is paired with the class's first, and only one goes on.
2. Tokens are ordered from rare to common by a sketch of the regions (any one order loses nothing). Of each window of
   `SPAN` tokens or a few more the `PREFIX` first are keys, but for those that an end of the window comes before: two
   windows whose ends are common, and that differ in fewer than `PREFIX` distinct tokens on each side (a similarity of 0.8
   leaves a fifth at most), share one. Where two regions have a key is a candidate.
3. In a key of more than `PIVOT` places each is paired with the first at first. Places that don't prove similar to
   that one are then compared with all places of the key, in blocks, a task for each pair of blocks; links that join
   what wasn't joined are handed on. So copies aren't expanded into all pairs: two places of one key that are similar are
   a pair of the result, or joined by pairs of it.

Result: one row for each passage of a document with the document that it shares it with: doc_id,
start and end in words (end excluded), other_doc_id, other_start, other_end, similarity.

A key of very many windows is dealt out (see dealt()): of one piece of the corpus only the first few windows keep it, so that
it is known as crowded; the others meet in a bucket of that piece.

Defined results: A-Z count as a-z; null and empty texts and texts under LENGTH + 4 words have no
passage; rows with a null id are left out, as they can't be named; rows that repeat an id with other texts each have
their passages, equal rows count once; passages repeated only within one id aren't reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runs import all_pairs, runs, table_of
from ._stage import bloom, in_bloom, spent, written
from ._text import U, Words, mix, pieces
from .jaccard import BINS, CHUNK, frequency_ranks, overlaps

K, LENGTH = 5, 46  # 46 five-word tokens: 50 words
FUNCTIONS, ENOUGH, PIVOT = 6, 3, 8
#: The shortest passage in tokens, and how many of its rarest are keys: a fifth may differ, and one more.
SPAN, PREFIX = LENGTH - 1, (LENGTH - 1) // 5 + 1
WIDE = SPAN + PREFIX - 1
BLOCK = 512
_RECT = ["a", "b", "la", "ca", "ra", "lb", "cb", "rb"]
_RECTS = "a long, b long, la int, ca int, ra int, lb int, cb int, rb int"
_SALT = mix(np.arange(1, 65, dtype=U) * U(0xA0761D6478BD642F))


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i : i + n], by doubling; of length len(x) - n + 1."""
    size, y = 1, x
    while size * 2 <= n:
        y = op(y[:-size], y[size:])
        size *= 2
    return y if size == n else op(y[: len(x) - n + 1], y[n - size : n - size + len(x) - n + 1])


def centres(h: np.ndarray, doc_end: np.ndarray, length: int) -> np.ndarray:
    """Places that hold the least hash of some window of `length` that lies within one document; doc_end: by place."""
    n = len(h)
    if n < length:
        return np.zeros(0, dtype=np.int64)
    least = _slide(h, length, np.minimum)
    least[np.arange(len(least)) + length > doc_end[: len(least)]] = 0
    pad = np.zeros(length - 1, dtype=U)
    best = _slide(np.concatenate([pad, least, pad]), length, np.maximum)
    return np.flatnonzero((best == h) & (h > 0))


def extents(h: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """l and r (excluded) of the compact window around each centre: the nearest smaller centre on either side, by a
    Cartesian tree built on a stack. Equal hashes: the left one counts as smaller. first, end: the document's bounds."""
    n = len(at)
    left, right = first.copy(), end.copy()
    stack: list[int] = []
    hs, fs, pos = h.tolist(), first.tolist(), at.tolist()
    for i in range(n):
        while stack and (fs[stack[-1]] != fs[i] or hs[stack[-1]] > hs[i]):
            j = stack.pop()
            if fs[j] == fs[i]:
                right[j] = pos[i]
        if stack:
            left[i] = pos[stack[-1]] + 1
        stack.append(i)
    return left, right


def dealt(key: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (some twice) and their keys, so that no key gets more than `most` + 1 rows of one piece.

    Of a key with more, the first `most` + 1 rows, in order of document, keep it; the further ones get a key of their
    piece's own, to which the first two documents' rows go as well. So a key of very many documents is dealt out to many
    tasks, and its first documents still meet those of other pieces."""
    order = np.lexsort((ids, key))
    at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(at, len(key)))
    rank = np.arange(len(key)) - np.repeat(at, size)
    big = np.repeat(size, size) > most + 1
    if not big.any():
        return np.arange(len(key)), key
    piece = mix(np.array([int(ids.min()) & ((1 << 64) - 1), int(ids.max()) & ((1 << 64) - 1)], dtype=U) + U(len(ids))).sum(dtype=U)
    of = ids[order]
    new = np.concatenate([[True], of[1:] != of[:-1]])
    new[at] = True
    nth = np.cumsum(new) - np.repeat(np.cumsum(new)[at] - 1, size)  # the document's place in its key, from 1
    head = big & new & (nth <= 2)
    rest = big & (rank > most)
    own = mix(key[order].view(U) ^ piece).view(np.int64)
    rows = np.concatenate([order[~rest], order[rest | (head & ~rest)]])
    return rows, np.concatenate([key[order][~rest], own[rest | (head & ~rest)]])


def windows(docs: DataFrame, k: int = K, length: int = LENGTH, functions: int = FUNCTIONS) -> DataFrame:
    """(key, doc_id, l, c, r): the compact windows of all documents; key: function and min-hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            g, ok = w.grams(k)
            n_of = np.maximum(np.diff(w.at) - k + 1, 0)
            g = g[ok]
            first_of = np.concatenate([[0], np.cumsum(n_of)])
            doc = np.repeat(np.arange(w.n_texts), n_of)
            ends = first_of[1:][doc] if len(doc) else doc
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            out = []
            for f in range(functions):
                h = mix(g ^ _SALT[f])
                c = centres(h, ends, length)
                if not len(c):
                    continue
                lo, hi = first_of[doc[c]], ends[c]
                left, right = extents(h[c], lo, hi, c)
                wide = right - left >= length
                c, left, right, lo = c[wide], left[wide], right[wide], lo[wide]
                out.append((mix(h[c] + U(f)).view(np.int64), ids[doc[c]], left - lo, c - lo, right - lo))
            if out:
                x = [np.concatenate(y) for y in zip(*out, strict=True)]
                rows, key = dealt(x[0], x[1], PIVOT)
                x = [key, *(y[rows] for y in x[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1], pa.int64()), *(pa.array(y.astype(np.int32)) for y in x[2:])], names=["key", "doc_id", "l", "c", "r"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, l int, c int, r int")


def meetings(wins: DataFrame, pivot: int = PIVOT) -> DataFrame:
    """(a, b, la, ca, ra, lb, cb, rb), a < b: windows of two documents that meet in a bucket of at most `pivot`. b is null: a
    is the key of a crowded bucket, whose windows regions() takes."""

    def run(batches):
        held: list[np.ndarray] = []
        crowded: list[int] = []

        def marks():
            none = [pa.nulls(len(crowded), pa.int64()), *[pa.nulls(len(crowded), pa.int32())] * 6]
            return pa.RecordBatch.from_arrays([pa.array(crowded, pa.int64()), *none], names=_RECT)

        def flush():
            x = np.concatenate(held)
            held.clear()
            cols = [x[:, 0], x[:, 4], *(x[:, i].astype(np.int32) for i in (1, 2, 3, 5, 6, 7))]
            return pa.RecordBatch.from_arrays([pa.array(y) for y in cols], names=_RECT)

        for what, rows, starts in runs((table_of(b, 5) for b in batches), pivot):
            if what == "short":
                for x, y in all_pairs(rows[:, 1:], starts):  # sorted by document within a run
                    ok = x[:, 0] != y[:, 0]
                    held.append(np.column_stack([x[ok], y[ok]]))
            elif what == "long":
                crowded.append(int(rows[0, 0]))
            if sum(map(len, held)) > 1 << 16:
                yield flush()
        if sum(map(len, held)):
            yield flush()
        if crowded:
            yield marks()

    return wins.repartition("key").sortWithinPartitions("key", "doc_id", "l").mapInArrow(run, _RECTS)


def regions(docs: DataFrame, crowded: np.ndarray, k: int = K, length: int = LENGTH, functions: int = FUNCTIONS) -> DataFrame:
    """(doc_id, name, at, tokens): the stretches of each document that sequences of `length` tokens cover of which some
    function has its min-hash in a crowded bucket; all windows of crowded buckets lie within them. at: the first token.

    crowded: a filter of bucket keys; what it lets through in error costs time only."""

    def run(batches):
        for b in pieces(batches):
            w = Words(b.column("text"))
            g, ok = w.grams(k)
            n_of = np.maximum(np.diff(w.at) - k + 1, 0)
            g = g[ok]
            if len(g) < length:
                continue
            first_of = np.concatenate([[0], np.cumsum(n_of)])
            doc = np.repeat(np.arange(w.n_texts), n_of)
            held = np.zeros(len(g) - length + 1, dtype=bool)
            for f in range(functions):
                least = _slide(mix(g ^ _SALT[f]), length, np.minimum)
                cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))  # one look for each stretch of one minimum
                held |= np.repeat(in_bloom(crowded, mix(least[cut] + U(f)).view(np.int64)), np.diff(np.append(cut, len(least))))
            at = np.flatnonzero(held & (np.arange(len(held)) + length <= first_of[1:][doc[: len(held)]]))
            if len(at):
                new = np.concatenate([[True], (at[1:] > at[:-1] + length) | (doc[at[1:]] != doc[at[:-1]])])
                start, end = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + length
                of = pa.array(doc[start])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("name").take(of), pa.array((start - first_of[doc[start]]).astype(np.int32)), pa.array([g[x:y].tobytes() for x, y in zip(start, end, strict=True)], pa.binary())], names=["doc_id", "name", "at", "tokens"])

    return docs.select("doc_id", "name", "text").mapInArrow(run, "doc_id long, name long, at int, tokens binary")


def _token_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        yield b, [np.unique(np.frombuffer(x.as_buffer(), dtype=U)) for x in b.column(0)]


def prefixes(tokens: np.ndarray, ranks: np.ndarray, span: int = SPAN, prefix: int = PREFIX) -> np.ndarray:
    """Places of a region's tokens that may be the first common one, by rank and hash, of a passage of `span` tokens or more.

    A passage begins and ends with common tokens, and at most `prefix` - 1 differ. So the first common one is among the
    `prefix` first of a window, neither end of the window comes before it, and an end is at most `prefix` - 1 places
    further on. That leaves out a text that is too short for a passage, however many documents hold it.
    A token that the window before it holds already counts as last, so that repeats take no place of others."""
    if len(tokens) < span:
        return np.zeros(0, dtype=np.int64)
    r = ranks[(tokens % U(len(ranks))).astype(np.int64)].astype(U)
    key = (r << U(56)) | (mix(tokens) >> U(8))
    order = np.argsort(tokens, kind="stable")
    again = np.flatnonzero((np.diff(tokens[order].view(np.int64)) == 0) & (np.diff(order) < span + prefix - 1)) + 1
    key[order[again]] = ~U(0)
    top = np.concatenate([np.partition(np.lib.stride_tricks.sliding_window_view(key[i : i + span - 1 + (1 << 14)], span), prefix - 1, axis=1)[:, prefix - 1] for i in range(0, len(key) - span + 1, 1 << 14)])
    ends = _slide(np.concatenate([key[span - 1 :], np.zeros(prefix - 1, dtype=U)]), prefix, np.maximum)
    most = np.minimum(np.minimum(top, key[: len(top)]), ends)
    most = np.concatenate([np.zeros(span + prefix - 2, dtype=U), most, np.zeros(span - 1, dtype=U)])
    return np.flatnonzero(key <= _slide(most, span + prefix - 1, np.maximum))


def chains(tokens: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of each chain of places p of one token, less than PREFIX apart, as in a text that goes round
    and round. A chain is taken as one place, with the text around all of it."""
    order = np.lexsort((p, tokens[p]))
    q, z = p[order], tokens[p][order]
    first = np.flatnonzero(np.concatenate([[True], (z[1:] != z[:-1]) | (q[1:] - q[:-1] >= PREFIX)])[: len(q)])
    return q[first], q[np.append(first[1:], len(q)) - 1] if len(q) else q


def fewest(tokens: np.ndarray) -> int:
    """The least number of distinct tokens in a window of SPAN tokens; few where a text goes round and round."""
    if len(tokens) < SPAN:
        return 1
    order = np.argsort(tokens, kind="stable")
    before = np.full(len(tokens), -1)
    same = np.flatnonzero(tokens[order][1:] == tokens[order][:-1])
    before[order[same + 1]] = order[same]
    windows_ = np.lib.stride_tricks.sliding_window_view(before, SPAN)
    return int((windows_ < np.arange(len(windows_))[:, None]).sum(axis=1).min())


def places(contents: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(z, doc_id, name, at, p, lo, hi): keys of regions (doc_id, name, at, tokens) and their places; lo and hi: the part of
    the region in which a window of WIDE tokens with the place, or with one of its chain, lies."""

    def run(batches):
        for b in batches:
            out = []
            start = b.column("at").to_numpy()
            for i, x in enumerate(b.column("tokens")):
                t = np.frombuffer(x.as_buffer(), dtype=U)
                p, last = chains(t, prefixes(t, ranks))
                out.append((t[p].view(np.int64), np.full(len(p), i), start[i] + p, start[i] + np.maximum(p - WIDE + 1, 0), start[i] + np.minimum(last + WIDE, len(t))))
            if out:
                z, of, *cols = (np.concatenate(y) for y in zip(*out, strict=True))
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(z), *(b.column(c).take(of) for c in ("doc_id", "name", "at")), *(pa.array(y.astype(np.int32)) for y in cols)], names=["z", "doc_id", "name", "at", "p", "lo", "hi"])

    return contents.select("doc_id", "name", "at", "tokens").mapInArrow(run, "z long, doc_id long, name long, at int, p int, lo int, hi int")


def first_two(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, n, x, y): of each key the number of rows and the rows of the least and the greatest name: rows of the least name
    pair with y, others with x, so that each pairs with a row of another name, if there is one."""
    row = F.struct("name", "doc_id", *more)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("x"), F.max(row).alias("y")).where("x.name <> y.name")


def _head() -> Column:
    return F.when(F.col("name") == F.col("x.name"), F.col("y")).otherwise(F.col("x"))


def _rects(pairs: DataFrame) -> DataFrame:
    """_RECT of pairs of places (doc, lo, p, hi) u and v, the lesser document first."""
    turned = F.col("u.doc_id") > F.col("v.doc_id")
    a, b = F.when(turned, F.col("v")).otherwise(F.col("u")), F.when(turned, F.col("u")).otherwise(F.col("v"))
    pairs = pairs.where("u.doc_id <> v.doc_id").select(a.alias("u"), b.alias("v"))
    return pairs.select(*(F.col(c).alias(n) for c, n in zip(("u.doc_id", "v.doc_id", "u.lo", "u.p", "u.hi", "v.lo", "v.p", "v.hi"), _RECT, strict=True)))


def near(posts: DataFrame, firsts: DataFrame, pivot: int = PIVOT) -> DataFrame:
    """As meetings(): all pairs of places of a key up to `pivot`, beyond that each place with a first one."""
    place = F.struct("name", "doc_id", "lo", "p", "hi")
    both = posts.join(firsts, "z")
    star = both.where(F.col("n") > pivot).select(place.alias("u"), _head().alias("v"))
    few = both.where(F.col("n") <= pivot).groupBy("z").agg(F.collect_list(place).alias("all"))
    few = few.select("all", F.posexplode("all").alias("i", "u")).select("u", F.explode(F.slice("all", F.col("i") + 2, pivot)).alias("v"))
    return _rects(star).union(_rects(few.where("u.name <> v.name")))


def unsettled(posts: DataFrame, firsts: DataFrame, verified: DataFrame, pivot: int = PIVOT) -> DataFrame:
    """The places of keys of more than `pivot` that no verified passage joins to the key's first place.

    A place of the first one's name is paired with the last one, so that one has to be joined to the first too."""
    star = posts.join(firsts.where(F.col("n") > pivot), "z").withColumns({"h": _head(), "hd": _head()["doc_id"]})
    passage = verified.select(F.col("a").alias("doc_id"), F.col("b").alias("hd"), "a0", "a1", "b0", "b1")
    covered = star.join(passage, ["doc_id", "hd"]).where("p >= a0 and p < a1 and h.p >= b0 and h.p < b1").select("z", "doc_id", "p").distinct()
    loose = written(star.join(covered, ["z", "doc_id", "p"], "left_anti").withColumn("first", F.expr("doc_id = x.doc_id and p = x.p")).select(*posts.columns, "first"), "loose")
    apart = star.join(loose.where("first").select("z"), "z", "left_semi").where("name = x.name and not (doc_id = x.doc_id and p = x.p)")
    out = written(loose.where("not first").select(*posts.columns).union(apart.select(*posts.columns)).distinct(), "open")
    spent(loose)
    return out


def rest_of_key(open_: DataFrame, posts: DataFrame, contents: DataFrame, block: int = BLOCK) -> DataFrame:
    """As meetings(): similar places of a key that join what isn't joined. Each open place is compared with all places of
    its key, in blocks: a task for each pair of blocks. At most one pair fewer than there are open places in it comes out of each."""
    own = F.xxhash64("doc_id", "p")
    mine = open_.select("z", "doc_id", "p", F.lit(True).alias("open"))
    keys = open_.groupBy("z").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nl"))
    size = posts.join(keys.select("z"), "z", "left_semi").groupBy("z").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nr"))
    d = posts.join(keys.join(size, "z"), "z").join(mine, ["z", "doc_id", "p"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    d = d.join(contents.select("doc_id", "at", "tokens"), ["doc_id", "at"]).withColumn("tokens", F.substring("tokens", 8 * (F.col("lo") - F.col("at")) + 1, 8 * (F.col("hi") - F.col("lo"))))
    columns = ["open", "doc_id", "name", "lo", "p", "hi", "tokens"]
    left = d.where("open").select("z", F.pmod(own, F.col("nl")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), F.lit(True).alias("left"), *columns)
    right = d.select("z", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), F.pmod(own, F.col("nr")).cast("int").alias("j"), F.lit(False).alias("left"), *columns)

    def run(_, table):
        side = table.column("left").to_numpy()
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        out = []
        if len(a) and len(b):
            doc, name, lo, p, hi = (table.column(c).to_numpy() for c in ("doc_id", "name", "lo", "p", "hi"))
            t = [np.frombuffer(x, dtype=U) for x in table.column("tokens").to_pylist()]
            sets = [np.unique(x) for x in t]
            n = np.array([fewest(x) for x in t])
            least = -(-(4 * np.minimum(n[a][:, None], n[b][None, :])) // 5)
            alike = (overlaps([sets[i] for i in a], [sets[i] for i in b]) >= least) & (name[a][:, None] != name[b][None, :])
            # places that are joined to the key's first one have one label
            label = {(int(doc[i]), int(p[i])): (int(doc[i]), int(p[i])) if o else None for i, o in enumerate(table.column("open").to_pylist())}
            root: dict = {}

            def top(v):
                while root.get(v, v) != v:
                    v = root[v]
                return v

            for i, j in zip(*np.nonzero(alike), strict=True):
                x, y = a[i], b[j]
                u, v = top(label[int(doc[x]), int(p[x])]), top(label[int(doc[y]), int(p[y])])
                if u == v:
                    continue
                x, y = (x, y) if doc[x] < doc[y] else (y, x)
                (at, to), (last, end) = (p[[x, y]] - lo[[x, y]]).tolist(), np.maximum(p[[x, y]] - lo[[x, y]], hi[[x, y]] - lo[[x, y]] - WIDE).tolist()
                got = [r for r in verify(t[x], t[y], 0, 0, LENGTH) if r[0] <= last and at < r[1] and r[2] <= end and to < r[3]]
                if got:
                    if u is None:
                        u, v = v, u
                    root[u] = v
                    out += [(doc[x], doc[y], lo[x] + s, lo[x] + s, lo[x] + e, lo[y] + f, lo[y] + f, lo[y] + g) for s, e, f, g, _ in got]
        return pa.table({c: pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(_RECT)})

    # dealt by all three: dealt by the key alone, all its blocks would be in one task
    return left.unionAll(right).repartition("z", "i", "j").groupBy("z", "i", "j").applyInArrow(run, _RECTS)


def joined(rect: np.ndarray, enough: int, length: int) -> list[tuple[int, int, int, int]]:
    """Candidate passages (start and end in a, in b) from rectangles la, ca, ra, lb, cb, rb of one pair of documents.

    Rectangles of nearly one diagonal (cb - ca) are swept along a; where `enough` overlap, their joint extent is a passage."""
    d = rect[:, 4] - rect[:, 1]
    rect = rect[np.argsort(d, kind="stable")]
    d = np.sort(d)
    out = []
    for part in np.split(rect, np.flatnonzero(np.diff(d) > length // 4) + 1):
        if len(part) < enough:
            continue
        lo = np.maximum(part[:, 0], part[:, 1] - (part[:, 4] - part[:, 3]))
        hi = np.minimum(part[:, 2], part[:, 1] + (part[:, 5] - part[:, 4]))
        events = np.concatenate([np.column_stack([lo, np.ones(len(part), dtype=np.int64)]), np.column_stack([hi, -np.ones(len(part), dtype=np.int64)])])
        events = events[np.lexsort((events[:, 1], events[:, 0]))]
        depth = np.cumsum(events[:, 1])
        inside = depth >= enough
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        for s in starts:
            rest = np.flatnonzero(~inside[s:])
            a0, a1 = int(events[s, 0]), int(events[s + (rest[0] if len(rest) else len(inside) - s - 1), 0])
            own = (lo < a1) & (hi > a0)
            shift = int(np.median(part[own, 4] - part[own, 1]))
            if out and a0 <= out[-1][1] and abs(shift - (out[-1][2] - out[-1][0])) <= length // 4:
                out[-1] = (out[-1][0], max(out[-1][1], a1), out[-1][2], max(out[-1][3], a1 + shift))
            else:
                out.append((a0, a1, a0 + shift, a1 + shift))
    return out


def verify(p: np.ndarray, q: np.ndarray, a0: int, b0: int, length: int) -> list[tuple[int, int, int, int, float]]:
    """Passages within p and q, parts of two token sequences from a0 and b0 on: (start, end, start, end, similarity), long
    and similar enough.

    Shared tokens form stretches along a diagonal; a stretch takes in the next ones, from left to right, as long as
    the token sets of what it then spans stay similar."""
    if len(p) == len(q) and (p == q).all():
        return [(a0, a0 + len(p), b0, b0 + len(q), 1.0)] if len(p) >= length - 1 else []
    order = np.argsort(q, kind="stable")
    by = q[order]
    lo, hi = np.searchsorted(by, p, "left"), np.searchsorted(by, p, "right")
    at = np.flatnonzero(hi > lo)
    stretches: list[list[int]] = []  # start and end in p, start and end in q
    if (hi[at] - lo[at] == 1).all():  # each shared token has one place
        to = order[lo[at]]
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(to) != 1)) + 1
        first, last = np.concatenate([[0], cut]), np.append(cut, len(at)) - 1
        stretches = [] if not len(at) else np.column_stack([at[first], at[last] + 1, to[first], to[last] + 1]).tolist()
    else:
        order_, lo_, hi_ = order.tolist(), lo.tolist(), hi.tolist()
        for i in at.tolist():
            places = order_[lo_[i] : hi_[i]]
            last = stretches[-1] if stretches else None
            goal = last[3] + i - last[1] if last else i
            j = places[0] if len(places) == 1 else min(places, key=lambda z: abs(z - goal))
            if last and i == last[1] and j == last[3]:
                last[1], last[3] = i + 1, j + 1
            else:
                stretches.append([i, i + 1, j, j + 1])

    def similarity(s: list[int]) -> float:
        u, v = np.unique(p[s[0] : s[1]]), np.unique(q[s[2] : s[3]])
        both = len(np.intersect1d(u, v, assume_unique=True))
        return both / (len(u) + len(v) - both)

    out = []
    now: list[int] | None = None
    alike = 1.0  # of a stretch by itself
    for s in [*stretches, None]:
        if now and s and s[0] - now[1] <= length and 0 <= s[2] - now[3] <= length:
            both = [now[0], s[1], now[2], s[3]]
            if (x := similarity(both)) >= 0.8:
                now, alike = both, x
                continue
        if now and now[1] - now[0] >= length - 1 and now[3] - now[2] >= length - 1:
            out.append((a0 + now[0], a0 + now[1], b0 + now[2], b0 + now[3], alike))
        now, alike = s, 1.0
    return out


def candidates(met: DataFrame, enough: int, length: int) -> DataFrame:
    """(a, b, a0, a1, b0, b1) from rectangles (_RECT, times: for how many functions each counts)."""
    rect = F.struct("la", "ca", "ra", "lb", "cb", "rb", "times")
    # a pair of documents has a bounded number of windows: those of its shorter text
    pairs = met.groupBy("a", "b").agg(F.collect_list(rect).alias("rects"), F.sum("times").alias("n")).where(F.col("n") >= enough).drop("n")

    def run(batches):
        for x in batches:
            a, b = x.column(0).to_pylist(), x.column(1).to_pylist()
            rects = x.column(2)
            flat = rects.flatten()
            cols = np.column_stack([flat.field(i).to_numpy() for i in range(6)]).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(rects.value_lengths().to_numpy())])
            times = flat.field(6).to_numpy()
            cols, at = np.repeat(cols, times, axis=0), np.concatenate([[0], np.cumsum(times)])[at]
            found = [(a[i], b[i], *c) for i in range(len(a)) for c in joined(cols[at[i] : at[i + 1]], enough, length)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], pa.int64() if j < 2 else pa.int32()) for j in range(6)], names=["a", "b", "a0", "a1", "b0", "b1"])

    return pairs.mapInArrow(run, "a long, b long, a0 int, a1 int, b0 int, b1 int")


def checked(docs: DataFrame, found: DataFrame, k: int, length: int) -> DataFrame:
    """(a, na, a0, a1, b, nb, b0, b1, similarity), in tokens, both ways: the passages of candidates (a written table), as a written table."""
    keep = bloom(found.select(F.explode(F.array("a", "b")).alias("doc_id")))

    def tokens(batches):
        for b in pieces(batches):
            ids = b.column("doc_id").to_numpy()
            hit = np.flatnonzero(in_bloom(keep, ids))
            if not len(hit):
                continue
            w = Words(b.column("text").take(pa.array(hit)))
            g, ok = w.grams(k)
            seqs = [g[s : max(s, e - k + 1)].tobytes() for s, e in zip(w.at[:-1], w.at[1:], strict=True)]
            names = b.column("name").take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), names, pa.array(seqs, pa.binary())], names=["doc_id", "name", "tokens"])

    seqs = docs.mapInArrow(tokens, "doc_id long, name long, tokens binary")
    seqs = written(seqs.join(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "tokens")
    schema = "a long, na long, a0 int, a1 int, b long, nb long, b0 int, b1 int, similarity double"

    def check(batches):
        for x in batches:
            a, na, b, nb, a0, b0, p, q = (x.column(i).to_pylist() for i in range(8))
            rows = []
            for i in range(x.num_rows):
                for s, e, t, u, j in verify(np.frombuffer(p[i], dtype=U), np.frombuffer(q[i], dtype=U), a0[i], b0[i], length):
                    rows.append((a[i], na[i], s, e, b[i], nb[i], t, u, j))
                    rows.append((b[i], nb[i], t, u, a[i], na[i], s, e, j))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["a", "na", "a0", "a1", "b", "nb", "b0", "b1", "similarity"])

    def part(tokens: str, start: str, end: str) -> Column:  # of 8 bytes each
        return F.substring(tokens, 8 * F.col(start) + 1, F.greatest(8 * (F.col(end) - F.col(start)), F.lit(0)))

    # only the candidate's part of each sequence goes on
    found = found.withColumns({c: F.greatest(c, F.lit(0)) for c in ("a0", "b0")})
    both = found.join(seqs.withColumnRenamed("doc_id", "a"), "a").select("a", F.col("name").alias("na"), "b", "a0", "b0", "b1", part("tokens", "a0", "a1").alias("p"))
    both = both.join(seqs.withColumnRenamed("doc_id", "b"), "b").where("na <> name").select("a", "na", "b", F.col("name").alias("nb"), "a0", "b0", "p", part("tokens", "b0", "b1").alias("q"))
    out = written(both.mapInArrow(check, schema), "verified")
    spent(seqs)
    return out


def passages(docs: DataFrame, k: int = K, length: int = LENGTH, functions: int = FUNCTIONS, enough: int = ENOUGH, block: int = BLOCK) -> DataFrame:
    """See the module's text. docs: doc_id, text, ..."""
    named = F.col("doc_id").cast("long")
    # a document is a row: an id and a text, under a hash of both
    docs = docs.where("doc_id is not null").select(F.xxhash64(named, "text").alias("doc_id"), named.alias("name"), "text")
    met = written(meetings(windows(docs, k, length, functions)), "meetings")
    crowded = bloom(met.where("b is null").select("a"))
    full = written(regions(docs, crowded, k, length, functions).withColumn("h", F.xxhash64("tokens")), "regions")
    size = F.col("at") + (F.length("tokens") / 8).cast("int")
    equal = full.select("h", "doc_id", "name", F.col("at").alias("lo"), F.col("at").alias("p"), size.alias("hi"))
    equal = equal.join(first_two(equal, "h", "lo", "p", "hi"), "h").select(F.struct("name", "doc_id", "lo", "p", "hi").alias("u"), _head().alias("v"))
    row = F.min(F.struct("name", "doc_id", "at")).alias("r")
    contents = written(full.groupBy("h").agg(row, F.first("tokens").alias("tokens")).select("r.*", "tokens"), "contents")
    total = contents.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0))).first()[0] // 8
    ranks = frequency_ranks(contents, k, min(BINS, max(CHUNK, 1 << total.bit_length())), "tokens", _token_sets)
    posts = written(places(contents, ranks), "places")
    firsts = written(first_two(posts, "z", "lo", "p", "hi"), "firsts")
    counts = F.lit(enough).alias("times")
    everything = met.where("b is not null").select(*_RECT, F.lit(1).alias("times")).union(_rects(equal).select(*_RECT, counts)).union(near(posts, firsts).select(*_RECT, counts))
    found = written(candidates(everything, enough, length), "passages")
    spent(met, full)
    first = checked(docs, found, k, length)
    spent(found)
    out = first
    left = unsettled(posts, firsts, first)
    if not left.isEmpty():
        found = written(candidates(rest_of_key(left, posts, contents, block).select(*_RECT, counts), enough, length), "passages")
        more = checked(docs, found, k, length)
        spent(found)
        out = first.union(more.join(first, ["a", "a0", "a1", "b", "b0", "b1"], "left_anti").select(*first.columns))
    spent(left, firsts, posts, contents)
    end = lambda c: (F.col(c) + (k - 1)).alias
    return out.select(F.col("na").alias("doc_id"), F.col("a0").alias("start"), end("a1")("end"), F.col("nb").alias("other_doc_id"), F.col("b0").alias("other_start"), end("b1")("other_end"), "similarity")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
