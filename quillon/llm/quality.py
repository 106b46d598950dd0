"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

A text's words and word pairs fall into `buckets` bins by xxhash64. Over the whole corpus one
aggregation counts each bin, in all rows (the raw multinomial) and in the trusted rows (the target
multinomial). A document's score is the mean over its n-grams of ln(p_target / p_raw); it is kept
if no base rule fails and the score is at least `threshold`. All work on a document happens within
its row; only (bin, count) pairs are shuffled, and `buckets` weights come back as one literal.

Defined results: a null or blank text has no words, fails the base rule and isn't kept; without
trusted rows every score is 0; a single word has one n-gram. Rows are treated one by one, so
repeated rows, null ids and further columns pass through; an input column named like an output
is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import SPACES, fixed, let, strip, without, words

BUCKETS = 1 << 14
#: Bound of the sample of trusted ids (those least by hash): the labelled rows that fit the target.
TRUSTED = 5000
THRESHOLD = -0.058
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
_W, _H, _G, _T, _D, _P = (f"__quality_{x}" for x in "whgtdp")


def _hashes(docs: DataFrame, keep: list[Column]) -> DataFrame:
    return docs.select(*keep, fixed(F.transform(words(docs["text"]), lambda x: F.xxhash64(x))).alias(_H))


def _bins(buckets: int) -> Column:
    """The bins of all words and word pairs."""
    h = F.col(_H)
    pair = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda y, i: F.xxhash64(F.get(h, i), y))
    return F.transform(F.concat(h, pair), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """At most `most` ids of good, non-toxic documents: a bounded, repeatable sample."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = 8.0) -> list[float]:
    """ln(p_target / p_raw) of each bin. `trusted`: distinct doc_id, of bounded number. The target's counts are joined by
    `prior` counts a bin, spread as in the raw corpus, so that a small target pulls no bin far from it."""
    mark = F.broadcast(trusted.select(F.col("doc_id").alias("__trusted")))
    d = _hashes(docs, [docs["doc_id"]]).join(mark, F.col("doc_id") == F.col("__trusted"), "left")
    grams = d.select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.explode_outer(_bins(buckets)).alias("b"))
    # explode_outer: for explode() Catalyst infers a filter that would compute the hashes anew for each word
    rows = grams.where("b is not null").groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()  # at most `buckets` rows
    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0.0] * buckets
    extra = prior * buckets
    return [math.log((t + extra * r / n_raw) / (n_target + extra)) - math.log(r / n_raw) if r else 0.0 for t, r in zip(target, raw, strict=True)]


def _repeats() -> tuple[Column, Column, Column]:
    """Hashes of 3-word windows; those found twice or more; the places of their windows, ascending."""
    h, t, d = F.col(_H), F.col(_T), F.col(_D)
    n = F.size(h)
    windows = F.transform(F.slice(h, 3, F.greatest(n - 2, F.lit(0))), lambda z, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), z))
    twice = let(F.sort_array(t), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
    twice = F.when(F.size(F.array_distinct(t)) == F.size(t), F.array().cast("array<long>")).otherwise(twice)
    few = F.filter(F.transform(t, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
    by_hash = F.array_sort(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    many = let(by_hash, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: (e["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (e["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"]))), lambda e: e["i"])))
    at = F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= 48, few).otherwise(many)
    return windows, twice, at


def quality(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) with the counts, the score and the verdict."""
    buckets = len(weights)
    table = F.expr(f"cast(split('{','.join(map(repr, weights))}', ',') as array<double>)")  # folded to one literal
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = _hashes(docs, [*without(docs, *OUT), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), (F.length(text) - F.length(strip(text, "#*$%&|<>"))).cast("long").alias("n_symbols"), F.length(strip(text, SPACES)).cast("long").alias("word_chars")])
    windows, twice, at = _repeats()
    d = d.withColumns({_G: fixed(_bins(buckets)), _T: fixed(windows)}).withColumn(_D, fixed(twice)).withColumn(_P, fixed(at))
    h, p = F.col(_H), F.col(_P)
    n = F.size(h)
    total = F.aggregate(F.col(_G), F.lit(0.0), lambda a, b: a + F.get(table, b))
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumns({"n_words": n.cast("long"), "n_repeat_words": covered.cast("long"), "score": F.when(n > 0, total / (2 * n - 1)).otherwise(0.0)})
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return d.select(*[c for c in docs.columns if c.lower() not in OUT], *OUT)


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Fits on docs and the labels table of sf_dir, then applies quality()."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, fit(docs, trusted_ids(labels)), threshold)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(spark, docs, sf_dir).select("doc_id", *OUT)
