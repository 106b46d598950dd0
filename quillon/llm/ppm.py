"""Language-model scores of documents by prediction by partial matching (PPM) over bytes.

Training documents are those whose crc32(doc_id as text) mod 5 is not 1. Their byte contexts of
orders 0 to `ORDER` form a trie with counts, gathered from all of their bytes: one aggregation counts
the longest n-grams, whose sums are the shorter ones. A text's code length is the sum over its bytes
and one end symbol: each is coded in its longest known context; where it hasn't followed, an escape is
coded with weight D / (T + D) (T occurrences, D symbols; method C) and the next shorter context is
used with all symbols of the longer one excluded. As a context's symbols all follow its suffix too,
what is excluded depends on the longer context alone, so both sums are stored with it. A text's first
contexts are filled with zero bytes; symbols never seen share the remaining 256 - D evenly.

Beside it a base score: words and one end per text, log10((c + 0.5) / (N + 0.5 (V + 1))).

A symbol's code length depends on its n-gram alone, and a word's term on its count. So the trie is a set of
tables (a level for each order), and one more table gives the value of each n-gram and word that occurs
anywhere in the corpus; both are made by joins and aggregations and stay distributed. The `hot` most
frequent keys' values go to the tasks (a table of bounded size), which sum what they can of each text in one pass; what
is left of a text, its rare n-grams and words with their counts in it, meets the table in a join by key and is
summed back to the text. `hot` changes the work, not the result.

Defined results: null is an empty text (one end symbol); a null id counts as training; repeated rows
each get a row; without training documents every context is unknown. Words by 63-bit, texts of one id by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import spent, written
from ._text import U, Words, buffers, pieces

ORDER = 5
END = 0xFF  # in no UTF-8 text
#: Keys whose values every task has.
HOT = 1 << 20
_WORD = U(1 << 63)  # set in the keys of words, never in those of n-grams
_END_WORD = U(0x5851F42D4C957F2D) | _WORD
_TEXT = 1 << 62  # set in the rows of whole texts


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))


def _symbols(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol) packed into one number for each byte and end of the texts; each text's first."""
    off, raw = buffers(column)
    n = len(off) - 1
    at = off + np.arange(n + 1)  # with the ends
    s = np.full(at[-1], END, dtype=U)
    ends = at[1:] - 1
    body = np.ones(len(s), dtype=bool)
    body[ends] = False
    s[body] = raw
    place = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))
    key = s.copy()
    for k in range(1, order + 1):
        before = np.zeros(len(s), dtype=U)
        before[k:] = s[:-k] if k < len(s) else s[:0]
        before[place < k] = 0
        key |= before << U(8 * k)
    return key, at


def _tally(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = [np.add.reduceat(np.concatenate([p[i] for p in parts])[order], at) if len(at) else np.zeros(0, dtype=np.int64) for i in range(1, len(parts[0]))]
    return (keys[at], *sums)


def key_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n): occurrences in training texts of each n-gram and word (ends among them) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in pieces(batches):
            train = ~b.column("out").to_numpy(zero_copy_only=False)
            for key, at in (_symbols(b.column("text"), order), _words(b.column("text"))):
                held.append(_tally([(key, np.repeat(train, np.diff(at)).astype(np.int64))]))
                size += len(held[-1][0])
            if size > 1 << 21:
                held = [_tally(held)]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["key", "n"])
                    held, size = [], 0
        if held:
            key, n = _tally(held)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    d = docs.select(held_out(docs["doc_id"]).alias("out"), "text").mapInArrow(run, "key long, n long")
    return d.groupBy("key").agg(F.sum("n").alias("n"))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and the end of each text; each text's first."""
    w = Words(column)
    return np.insert(w.hash | _WORD, w.at[1:], _END_WORD), w.at + np.arange(len(w.at))


class Table:
    """Values by 64-bit key: a direct-mapped table, frequent keys first, and a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weight: np.ndarray):
        bits = max(4, math.ceil(math.log2(max(1, len(keys)))) + 1)
        self.shift = U(64 - bits)
        order = np.argsort(-weight, kind="stable")
        keys, values = keys[order], values[order]
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys, self.values = np.zeros(1 << bits, dtype=U), np.zeros(1 << bits, dtype=values.dtype)
        self.used = np.zeros(1 << bits, dtype=bool)
        self.keys[slot[first]], self.values[slot[first]], self.used[slot[first]] = keys[first], values[first], True
        rest = np.ones(len(keys), dtype=bool)
        rest[first] = False
        by = np.argsort(keys[rest])
        self.more, self.more_values = keys[rest][by], values[rest][by]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and whether there is one."""
        slot = self._slot(keys)
        found = (self.keys[slot] == keys) & self.used[slot]
        values = np.where(found, self.values[slot], self.values.dtype.type(0))
        miss = np.flatnonzero(~found)
        if len(miss) and len(self.more):
            at = np.minimum(np.searchsorted(self.more, keys[miss]), len(self.more) - 1)
            hit = self.more[at] == keys[miss]
            values[miss[hit]], found[miss[hit]] = self.more_values[at[hit]], True
        return values, found


def _gram(k: int, of: str = "g") -> Column:
    """The n-gram of order k (k bytes and a symbol) at the end of a longer one."""
    return F.col(of).bitwiseAND((1 << 8 * (k + 1)) - 1)


def _bounded(level: DataFrame, bytes_: int) -> DataFrame:
    """A table by keys of so many bytes: with up to two it has at most 2 ** 16 rows and may go to all tasks."""
    return F.broadcast(level) if bytes_ <= 2 else level


def trie(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order the n-grams' counts (g, c), and of each context (x, total, kinds, lost): T, D, and what escaping
    to its suffix leaves out of that one's T."""
    grams = [written(counts.where("key >= 0 and n > 0").select(F.col("key").alias("g"), F.col("n").alias("c")), "level")]
    for k in range(order - 1, -1, -1):
        grams.insert(0, written(grams[0].groupBy(_gram(k).alias("g")).agg(F.sum("c").alias("c")), "level"))
    levels = []
    for k, g in enumerate(grams):
        if k:
            lower = _bounded(grams[k - 1].select(F.col("g").alias("s"), F.col("c").alias("l")), k)
            g = g.withColumn("s", _gram(k - 1)).join(lower, "s")
        else:
            g = g.withColumn("l", F.lit(0).cast("long"))
        contexts = g.groupBy(F.shiftright("g", 8).alias("x")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("l").alias("lost"))
        levels.append((grams[k], written(contexts, "contexts")))
    return levels


def values(counts: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, n, value): log10 of the probability of each n-gram's symbol in its context; for words that occur in training their count."""
    order = len(levels) - 1
    grams, contexts = levels[order]
    known = grams.withColumn("x", F.shiftright("g", 8)).join(contexts, "x")
    out = known.select(F.col("g").alias("key"), F.col("c").alias("n"), F.log10(F.col("c") / (F.col("total") + F.col("kinds"))).alias("value"))
    out = out.unionAll(counts.where("key < 0 and n > 0").select("key", "n", F.col("n").cast("double").alias("value")))
    zero = F.lit(0).cast("long")
    left = counts.where("key >= 0 and n = 0").select("key", F.lit(0.0).alias("value"), zero.alias("gone"), zero.alias("gone_kinds"))
    for k in range(order, -1, -1):
        grams, contexts = levels[k]
        d = left.withColumn("g", _gram(k, "key")).withColumn("x", F.shiftright("g", 8))
        d = d.join(_bounded(contexts, k), "x", "left").join(_bounded(grams, k + 1), "g", "left")
        total, kinds = F.col("total") - F.col("gone"), F.col("kinds") - F.col("gone_kinds")
        code = F.when(F.col("c").isNotNull(), F.log10(F.col("c") / (total + kinds))).when(total > 0, F.log10(kinds / (total + kinds))).otherwise(0.0)
        d = d.select("key", (F.col("value") + code).alias("value"), F.coalesce("lost", zero).alias("gone"), F.coalesce("kinds", zero).alias("gone_kinds"), F.col("c").isNotNull().alias("coded"))
        d = written(d, "escapes")
        out = out.unionAll(d.where("coded").select("key", zero.alias("n"), "value"))
        left = d.where("not coded").drop("coded")
    symbols = levels[0][0].count()  # at most 256
    return out.unionAll(left.select("key", zero.alias("n"), (F.col("value") - math.log10(256 - symbols)).alias("value")))


def _grade(n: Column) -> Column:
    """A number that grows with n: n itself below 256, then in steps of a sixteenth of a doubling (under 1,200 of them)."""
    return F.when(n < 256, n).otherwise(F.floor(16 * F.log2(n)) + 128).cast("int")


def hottest(table: DataFrame, hot: int) -> tuple[Table, int]:
    """The values of the most frequent keys, at most `hot`, and the least grade of their counts."""
    sizes = {r["q"]: r["m"] for r in table.where("n > 0").groupBy(_grade(F.col("n")).alias("q")).agg(F.count(F.lit(1)).alias("m")).collect()}
    least, size = max(sizes, default=0) + 1, 0
    for q in sorted(sizes, reverse=True):
        if size + sizes[q] > hot:
            break
        least, size = q, size + sizes[q]
    t = table.where((F.col("n") > 0) & (_grade(F.col("n")) >= least)).select("key", "n", "value").toArrow()  # at most `hot` rows
    return Table(t.column("key").to_numpy().view(U), t.column("value").to_numpy(), t.column("n").to_numpy()), least


def score(docs: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = written(key_counts(docs, order), "counts")
    tokens, vocabulary = counts.where("key < 0 and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    base = math.log10(tokens + 0.5 * (vocabulary + 1))
    levels = trie(counts, order)
    table = written(values(counts, levels), "values")
    spent(counts, *(t for level in levels for t in level))
    near, least = hottest(table, hot)
    names = ["doc_id", "th", "key", "m", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n = b.num_rows
            sums, rest = [], []
            for key, at in (_symbols(b.column("text"), order), _words(b.column("text"))):
                value, found = near.get(key)
                far = np.flatnonzero(~found)
                of = np.searchsorted(at, far, "right") - 1
                by = np.lexsort((key[far], of))
                of, cold = of[by], key[far][by]
                cut = np.flatnonzero(np.concatenate([[True], (cold[1:] != cold[:-1]) | (of[1:] != of[:-1])])) if len(cold) else np.zeros(0, dtype=np.int64)
                rest.append((of[cut], cold[cut], np.diff(np.append(cut, len(cold)))))
                sums.append((value, found, at))
            (value, _, at), (count, found, words) = sums
            total = np.add.reduceat(value, at[:-1])
            logs = np.add.reduceat(np.where(found, np.log10(count + 0.5) - base, 0.0), words[:-1])
            known = np.add.reduceat(found.astype(np.int64), words[:-1])
            th = b.column("th").to_numpy()
            of = np.concatenate([rest[0][0], rest[1][0]])
            who = pa.array(np.concatenate([np.arange(n), of]))
            key = np.concatenate([th & (_TEXT - 1) | _TEXT, rest[0][1].view(np.int64), rest[1][1].view(np.int64)])
            m = np.concatenate([np.ones(n, dtype=np.int64), rest[0][2], rest[1][2]])
            more = len(of)
            texts = [pa.array(x, pa.int64()) for x in (np.diff(words), known)] + [pa.array(x) for x in (logs, total)]
            columns = [pa.concat_arrays([x, pa.nulls(more, x.type)]) for x in (b.column("out"), *texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(who), b.column("th").take(who), pa.array(key), pa.array(m), *columns], names=names)

    d = docs.select("doc_id", F.xxhash64("text").alias("th"), held_out(docs["doc_id"]).alias("out"), "text")
    d = d.mapInArrow(run, "doc_id long, th long, key long, m long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    rare = table.where((F.col("n") == 0) | (_grade(F.col("n")) < least)).select("key", "value")
    d = d.join(rare, "key", "left")
    m, whole, word = F.col("m"), F.col("n_tokens").isNotNull(), F.col("key") < 0
    count = F.coalesce("value", F.lit(0.0))
    d = d.groupBy("doc_id", "th").agg(
        F.count("n_tokens").alias("copies"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(whole, F.col("n_known")).when(word & (count > 0), m).otherwise(0)).alias("n_known"),
        F.sum(F.when(whole, F.col("base_score")).when(word, m * (F.log10(count + 0.5) - F.lit(base))).otherwise(0.0)).alias("base_score"),
        F.sum(F.when(whole, F.col("score")).when(word, 0.0).otherwise(m * F.col("value"))).alias("score"),
    )
    # equal rows have equal parts, all of them summed here; they are told apart again
    d = d.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return d.select("doc_id", "held_out", "n_tokens", F.expr("n_known div copies").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
