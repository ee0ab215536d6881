"""The corpus pipeline: language ID, quality, near-dedup, mixing, packing.

Each stage gets what its predecessor kept. All but the last hand on whole rows of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.llm import language, minhash, mixing, packing, quality
from fileledger.llm.common import held_out
from fileledger.session import ensure_checkpoint_dir

#: A text goes when its language is undetermined, or when nothing in it speaks for any.
LEAST_LANGUAGE_SCORE = 0.35


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is known. Texts that are null or without a letter go."""
    learn = docs.filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang")
    return language.keep_identified(docs, language.fit_pieces(learn), LEAST_LANGUAGE_SCORE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier predicts to be good. Null texts count as empty; repeated rows go or stay together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five words, similarity 0.8.

    Rows are told apart by 128 bits of the whole row, as doc_ids may repeat or be null; of equal
    rows one stays. Null texts and texts without a word have no near copy, and stay.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns]
    key = F.concat_ws("-", F.xxhash64(*columns), F.xxhash64(F.lit("row"), *columns))
    rows = docs.select(key.alias("doc_id"), F.struct(*docs.columns).alias("row"))
    kept = minhash.near_duplicates(rows.select("doc_id", "row.text"), width=5, percent=80).filter("kept").select("doc_id")
    return rows.join(kept.distinct(), "doc_id").dropDuplicates(["doc_id"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and parts of the texts, so that the sources have their target weights.

    Null texts have no word and stay out; ties of the random order go by id and size; repeated rows
    are mixed one by one.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 2048 tokens. Null and empty texts are the end id alone."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Several stages learn a model, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and reread."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")
