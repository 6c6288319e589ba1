"""The queries ``op1_`` to ``op12_``: each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from residua.llm import embedding_links, fill_middle, sharding
from residua.llm._shared import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every document to a token file and read its documents back."""
    import public_tokenizers

    from residua.llm._shared import new_path
    from residua.llm.token_blocks import token_digests, write_tokens

    path = new_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, path)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40, by proportional stratified interleaving."""
    from residua.llm.sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that contexts add."""
    from residua.llm.pii import find, spans_text

    found = find(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_text().alias("spans"), "n_added", "n_secret", "n_found")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between documents that share a passage of fifty words or more."""
    from residua.llm.passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from residua.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, fitted on the labels that are not held out."""
    from residua.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), keep=["doc_id"])


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vector whose id is divisible by 20."""
    from pyspark.sql import functions as F

    from residua.llm.neighbours import search

    return search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, within the edit budget."""
    from residua.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from residua.llm.html_text import main_text

    return main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the byte-level BPE ids of every document and of their decoding."""
    import public_tokenizers

    from residua.llm.byte_bpe import digests

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, at a cosine of 0.9 or more."""
    return embedding_links.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), keep=["vec_id"])


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document cut into lines and rearranged, and of its text restored."""
    outputs = fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return fill_middle.digests(outputs, ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": op1_token_blocks,
    "op2_shards": op2_shards,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_passages": op5_passages,
    "op6_simhash": op6_simhash,
    "op7_neighbours": op7_neighbours,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_text": op10_html_text,
    "op11_embedding_links": op11_embedding_links,
    "op12_fill_middle": op12_fill_middle,
}

ORACLE_SQL: dict[str, str] = {"op2_shards": sharding.ORACLE_SQL, "op11_embedding_links": embedding_links.ORACLE_SQL, "op12_fill_middle": fill_middle.ORACLE_SQL}
