"""The corpus pipeline: stages over `documents`, each an operator of quillon.llm applied to all that its predecessor kept.

Quality rules drop what they reject; of each near-duplicate group one row stays (rows are judged by their texts, not
by their ids); documents into which a benchmark item leaks go; personal data is replaced by its kind in brackets; what is left is
encoded by a public byte-level BPE vocabulary. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, jaccard, pii, quality, tiling
from quillon.llm._stage import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.scored(spark, docs, sf_dir).where("kept").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs).select(*docs.columns)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, pii.accepted(pii.pattern_counts(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but the text, then n_tokens, ids, and the digest of the decoded ids."""
    d = bpe.encoded(docs, bpe.public_tokenizer())
    return d.select(*(c for c in docs.columns if c != "text"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", unleaked),
    ("PII", private),
    ("byte-level BPE", tokens),
]
#: Trained, hashed and iterative stages; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
