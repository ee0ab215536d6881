"""One query for each operator, with production parameters over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.llm import (
    class_lm, hamming, language, minhash, mixing, neighbours, packing, prefix_trie, quality, resampling, sharding, toxicity, url_filter,
)
from fileledger.llm.common import held_out


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, folder, "pages"))


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict_language(_read(spark, folder, "documents"))


def vector_components(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_vectors(_read(spark, folder, "embeddings"))


def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_passages(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def document_components(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, folder, "documents"), width=3, percent=85)


def document_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, folder, "documents"))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every row whose id is divisible by 50 is a query against all rows."""
    vectors = _read(spark, folder, "embeddings")
    return hamming.nearest_codes(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_read(spark, folder, "documents"))


def text_scores(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.class_scores(_read(spark, folder, "documents"), held_out(F.col("doc_id"), 10, 0))


def conversation_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.shared_conversation_trie(_read(spark, folder, "conversations"))


def resampled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), longest=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_verdicts,
        "op2_quality": quality_scores,
        "op3_mixing": source_mix,
        "op4_language": document_languages,
        "op5_neighbours": vector_components,
        "op6_toxicity": toxic_scores,
        "op7_minhash": document_components,
        "op8_sharding": document_shards,
        "op9_hamming": nearest_vectors,
        "op10_packing": packed_documents,
        "op11_class_lm": text_scores,
        "op12_prefix_trie": conversation_nodes,
        "op13_resampling": resampled_documents,
    }
