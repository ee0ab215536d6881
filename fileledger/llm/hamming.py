"""Exact top-k search over binary codes by incremental multi-index hashing (Norouzi et al. 2014).

A code is the signs of a vector, cut into segments of SEGMENT bits. Two codes at distance d
agree in some segment up to d // segments bits, so once all segments were searched up to
radius r, every code nearer than segments * (r + 1) has been met. The radius grows, for the
queries that still need it, until the distance of the k-th verified neighbour lies below that.

Rows with the same code are one class; of a class the k + 1 smallest ids are enough, because
no other row of it can be among the k nearest. Everything is DataFrame operations.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileledger.session import cut_lineage

SEGMENT = 16


def sign_code(embedding: Column) -> Column:
    """Segments of SEGMENT sign bits; null for vectors that are null, empty or hold null or non-finite values."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    starts = F.sequence(F.lit(1), F.size(embedding), F.lit(SEGMENT))

    def segment(start: Column) -> Column:
        bits = F.slice(embedding, start, F.lit(SEGMENT))
        return F.aggregate(bits, F.lit(0), lambda s, x: s * 2 + (x >= 0).cast("int"))

    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad, F.transform(starts, segment))


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def masks(radius: int) -> list[int]:
    """All segment values with ``radius`` bits set."""
    return [sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)]


def nearest_codes(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query row and rank: query_id, rank, vec_id, distance.

    ``vectors`` and ``queries`` have vec_id and embedding. Neighbours are the k rows, the
    query's own id left out, with the least Hamming distance of sign codes, ties by smaller
    vec_id. A query with fewer than k other rows gets all of them. Rows without a code (vectors
    that are null, empty or hold null or non-finite components) or without an id are neither
    found nor answered; codes of different dimensions do not meet. Repeated query ids are
    answered once; a vec_id that several rows share is found once per code.
    """
    def coded(df: DataFrame) -> DataFrame:
        c = df.select("vec_id", F.size("embedding").alias("dim"), sign_code(F.col("embedding")).alias("code"))
        return c.filter("vec_id is not null and code is not null")

    # Classes of equal codes: their k + 1 smallest ids.
    first = Window.partitionBy("dim", "code").orderBy("vec_id")
    ids = coded(vectors).distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    classes = ids.groupBy("dim", "code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = cut_lineage(classes)
    asked = cut_lineage(coded(queries).distinct())
    segments = F.posexplode("code").alias("at", "value")
    index = cut_lineage(classes.select("dim", "code", F.size("ids").alias("many"), segments))
    open_codes = asked.select("dim", F.col("code").alias("asked")).distinct()
    open_codes = cut_lineage(open_codes.select("*", F.xxhash64("dim", "asked").alias("q"), (F.size("asked") * SEGMENT).alias("bound")))
    # Rows in the dimension of a query tell when all there is has been found.
    found = None
    for radius in range(SEGMENT + 1):
        probes = open_codes.select("dim", "asked", "q", "bound", F.posexplode("asked").alias("at", "value"))
        probes = probes.withColumn("mask", F.explode(F.lit(masks(radius))))
        probes = probes.select("dim", "asked", "q", "bound", "at", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(
            index.withColumnsRenamed({"dim": "_dim", "at": "_at", "value": "_value"}),
            (F.col("dim") == F.col("_dim")) & (F.col("at") == F.col("_at")) & (F.col("value") == F.col("_value"))
            & (distance(F.col("asked"), F.col("code")) <= F.col("bound")),
        )
        new = met.select("q", "dim", "asked", "code", "many", distance(F.col("asked"), F.col("code")).alias("distance"))
        every = new if found is None else found.unionAll(new)
        every = every.distinct()
        # The bound: the least distance within which k + 1 ids lie, the query's own among them.
        within = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        every = every.withColumn("_sum", F.sum("many").over(within))
        limit = F.min(F.when(F.col("_sum") >= k + 1, F.col("distance"))).over(Window.partitionBy("q"))
        every = every.withColumn("_limit", limit).filter(F.col("_limit").isNull() | (F.col("distance") <= F.col("_limit")))
        every = cut_lineage(every)
        found = every.drop("_sum", "_limit")
        reached = every.filter("_limit is not null").groupBy("q").agg(F.max("_limit").alias("_limit"))
        left = open_codes.join(reached, "q", "left").withColumn("bound", F.coalesce("_limit", "bound")).drop("_limit")
        covered = F.size("asked") * (radius + 1) - 1
        open_codes = cut_lineage(left.filter(F.col("bound") > covered))
        if open_codes.isEmpty():
            break
    best = asked.withColumnsRenamed({"vec_id": "query_id", "code": "asked"}).withColumn("q", F.xxhash64("dim", "asked"))
    hits = best.select("query_id", "q").join(found.select("q", "code", "dim", "distance"), "q")
    hits = hits.join(classes, ["dim", "code"]).select("query_id", "distance", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
