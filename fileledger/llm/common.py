"""Helpers that several operators share: words, prefix sums, components, tokenizer files."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fileledger.session import cut_lineage

#: A word is a run of anything but ASCII white space; bytes.split() cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold kept for evaluation. A null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hand_back() -> None:
    """Return what a task no longer needs to the machine: its worker goes on to other tasks, and
    workers of earlier stages share the executor's memory with those of the present one."""
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of a narrow table that make a task worth its files in an exchange.
ROWS_A_TASK = 20_000


def in_few_tasks(df: DataFrame) -> DataFrame:
    """Materialise a narrow table and read it in tasks of about ROWS_A_TASK rows.

    Each task leaves files in every later exchange; a small result spread over all shuffle
    partitions costs more in files than in rows. Large tables keep their partitions.
    """
    kept = cut_lineage(df)
    return kept.coalesce(kept.count() // ROWS_A_TASK + 1)


def prefix_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column, name: str = "before"
) -> DataFrame:
    """Add the sum of ``weight`` over the earlier rows of the same group.

    Rows are range-sorted by group and order, so that a hot group spreads over many
    partitions. Each partition sums its own rows; one small row per (partition, group)
    then gives the offset of that partition. Ties of the order are numbered in any
    order. The input is read twice (range bounds are sampled): hand over a narrow,
    materialised table. The result is materialised, so repeated reads agree.
    """
    parts = shuffle_partitions(df.sparkSession)
    keys = [F.col(c) for c in (*group, *order)]
    ranged = df.withColumn("_w", weight.cast("long")).repartitionByRange(parts, *keys)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut_lineage(ranged.withColumn("_local", F.coalesce(F.sum("_w").over(local), F.lit(0))))
    totals = summed.groupBy("_pid", *group).agg(F.sum("_w").alias("_w"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
    offsets = offsets.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group], "_offset")
    match = F.col("_pid") == F.col("_p")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = summed.join(offsets, match).withColumn(name, F.col("_local") + F.col("_offset"))
    return joined.select(*df.columns, name)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component), component = smallest node.

    Alternating large-star and small-star steps. A node's smallest neighbour is an
    algebraic aggregate, so a node with very many links combines before the exchange.
    Nodes without a link do not appear. Each round is written to the checkpoint folder.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("u"), F.col("v")).unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = in_few_tasks(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        near = both(e)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = in_few_tasks(small.filter("u <> v").distinct())
        # Done when every edge is a star: no target is itself a source.
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
