"""Importance resampling towards a target distribution over hashed word n-grams (Xie et al. 2023).

A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes of a text, and
bytes.split() yields its words. The crc32 of an n-gram goes on from that of its beginning, so
each longer run costs one more step; counters add up the buckets of a task, and Spark those of
all tasks. A bucket gains what the target has more of than the corpus; a document's weight is
the sum over its features. Adding Gumbel noise of the id turns the highest scores into a draw
without replacement. The highest are found by a range sort with distributed prefix sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import prefix_sums
from fileledger.session import cut_lineage

#: What stays: digits, small letters and all bytes beyond ASCII. Capitals become small, the rest blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def feature_hashes(words: list[bytes], longest: int) -> list[int]:
    """The crc32 of every run of 1 to ``longest`` words joined by one space."""
    level = list(map(crc32, words))
    found = level
    for n in range(1, min(longest, len(words))):
        level = [crc32(w, crc32(b" ", so_far)) for w, so_far in zip(words[n:], level, strict=False)]
        found = found + level
    return found


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket. One row for each bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total.update([h % buckets for h in feature_hashes(words_of(text.as_py() or b""), longest)])
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets)
    for row in rows.collect():  # at most one row for each bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the add-one shares of target and corpus, rounded down."""
    ratio = (target + 1) * (corpus.sum() + len(corpus)) / ((corpus + 1) * (target.sum() + len(target)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from a hash of seed and id; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed_documents(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight."""
    table = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                found = np.array(feature_hashes(words, longest), np.int64)
                n_words.append(len(words)), n_features.append(len(found))
                weight.append(int(gain[found % len(gain)].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, least_words: int = 20,
    percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, and rank of those drawn.

    Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn:
    those of the highest scores, ties to the smaller doc_id, a null id last. Rows equal in score
    and id follow their weight and features; rows equal in all are drawn one by one. Null and
    empty texts have no feature, weight 0 and are not drawn unless ``least_words`` is 0. Null
    target texts count nothing; an empty target leaves add-one shares; an empty table gives no
    row. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weighed_documents(docs, gains, longest)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    fits = F.col("n_words") >= least_words
    scored = cut_lineage(
        scored.withColumns({"out": (~fits).cast("int"), "down": -F.col("score"), "no_id": F.col("doc_id").isNull()})
    )
    drawn = scored.filter("out = 0").count() * percent // 100
    ranked = prefix_sums(scored, [], ["out", "down", "no_id", "doc_id", "weight", "n_features"], F.lit(1), "rank")
    rank = F.when(fits & (F.col("rank") < drawn), F.col("rank") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
