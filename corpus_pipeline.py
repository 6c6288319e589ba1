"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import byte_bpe, decontaminate, pii, quality, simhash
from residua.llm._shared import bound_batches, new_path, remove_path, scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Null and empty texts are
    judged like any other, repeated rows alike; without labels all stay."""
    bound_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five
    words, a similarity of 0.8 or more.  The smallest doc_id stays, null last; null and
    empty texts are one group."""
    bound_batches(spark)
    return simhash.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go; null and empty
    texts hold none."""
    bound_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts give way to their kind in square
    brackets, and n_chars follows.  Null stays null; repeated rows are masked alike."""
    bound_batches(spark)
    found = pii.find(docs)
    hidden = found.withColumn("text", pii.mask())
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return hidden.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of their decoding.
    Null and empty texts have no ids; repeated rows are encoded each on their own."""
    # The memory of words is smaller than for the operator alone: the stages before
    # have left their marks on the executors' heaps.
    bound_batches(spark)
    return byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN, keep=[c for c in docs.columns if c != "text"], with_ids=True, cache_words=100_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("byte-level BPE", encode_stage),
]

#: No stage but the third could be written in SQL that ends in reasonable time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  An empty table gives an empty result; columns
    named like those of the last stage (n_tokens, ids, ...) are replaced there.  The
    table of a stage is deleted when the next one's is there; the last is what the
    result reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{k}")
        with scratch(spark):  # what a stage has written goes when its result is there
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
