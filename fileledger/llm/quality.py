"""Quality classifier: random Fourier features, ridge by partition-summed normal equations,
isotonic calibration.

One pass turns each whole text into a few statistics. Random cosines of them approximate a
Gaussian kernel. Every partition of labelled rows adds up its own normal equations; the sums
are added by matrix row, so that one group holds one row per partition. The calibration uses
scores of folds that their own fit has not seen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import hand_back, held_out
from fileledger.session import cut_lineage

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "upper", "digits", "punctuation", "symbols", "bars",
    "spaces", "distinct_words", "top_word", "repeated_neighbours", "repeated_lines", "marked_words", "compressed",
)
FEATURES = 192
FOLDS = 4
BINS = 400
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_ALNUM = np.concatenate([_UPPER, _LOWER, _DIGIT])
_PUNCT = np.setdiff1d(np.arange(33, 127), _ALNUM)
_SYMBOL = np.frombuffer(b"#$%&*@^~<>=+_\\{}[]", np.uint8)
_MARKS = frozenset("!#$%&*@^~|+=<>")


def statistics_of(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    data = text.encode()
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    chars, n = max(1, len(data)), max(1, len(words))
    letters = max(1, by_byte[_UPPER].sum() + by_byte[_LOWER].sum())
    counts = Counter(words)
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / n,
        by_byte[_UPPER].sum() / letters, by_byte[_DIGIT].sum() / chars, by_byte[_PUNCT].sum() / chars,
        by_byte[_SYMBOL].sum() / chars, by_byte[124] / chars, by_byte[_SPACE].sum() / chars,
        len(counts) / n**0.8, (max(counts.values()) if counts else 0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(w[-1] in _MARKS for w in words) / n,
        len(zlib.compress(data, 1)) / chars,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and x, the statistics of the whole text; null counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics_of(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])
        hand_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, x array<double>")


class Cosines:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0.0, 1.0 / np.sqrt(len(mean)), (len(mean), features))
        self.b = rng.uniform(0.0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        cos = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([cos, np.ones((len(x), 1))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit (pool adjacent violators) of bin means in bin order."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def fit_quality(train: DataFrame, features: int = FEATURES, ridge: float = 1e-3):
    """The scorer from (doc_id, x, y): a function of a matrix of statistics, or None without labels."""
    k = len(STATISTICS)
    sums = train.agg(
        F.count("*").alias("n"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(k)],
    ).first()
    if not sums["n"]:
        return None
    cosines = Cosines(np.array([sums[f"m{i}"] for i in range(k)]), np.array([sums[f"s{i}"] for i in range(k)]), features)
    folded = train.select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    d = features + 1

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, d, d + 1))
        for f in frames:
            z, y, fold = cosines(_stack(f["x"], k)), f["y"].to_numpy(), f["fold"].to_numpy()
            for i in range(FOLDS):
                own = z[fold == i]
                total[i] += np.hstack([own.T @ own, own.T @ y[fold == i, None]])
        for i in range(FOLDS):
            if total[i].any():
                yield pd.DataFrame({"fold": i, "line": np.arange(d), "values": list(total[i])})

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "line": [key[1]], "values": [np.sum(np.stack(f["values"].to_numpy()), axis=0)]})

    lines = folded.mapInPandas(equations, "fold int, line int, values array<double>")
    by_fold = np.zeros((FOLDS, d, d + 1))
    for r in lines.groupBy("fold", "line").applyInPandas(add, "fold int, line int, values array<double>").collect():
        by_fold[r["fold"], r["line"]] = r["values"]

    def solve(system: np.ndarray) -> np.ndarray:
        n = max(1.0, system[-1, -2])
        return np.linalg.solve(system[:, :-1] + ridge * n * np.eye(d), system[:, -1])

    whole = by_fold.sum(0)
    final, apart = solve(whole), np.stack([solve(whole - own) for own in by_fold])

    def unseen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = (cosines(_stack(f["x"], k)) * apart[f["fold"].to_numpy()]).sum(1)
            yield pd.DataFrame({"bin": np.floor(np.clip(raw, -1, 2) * BINS).astype(np.int32), "y": f["y"].to_numpy()})

    # At most 3 * BINS + 1 bins.
    bins = folded.mapInPandas(unseen, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    at = np.array(sorted((r["bin"], r["n"], r["y"]) for r in bins), dtype=float)
    centre, fitted = (at[:, 0] + 0.5) / BINS, isotonic(at[:, 2] / at[:, 1], at[:, 1])

    def score(x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(cosines(x) @ final, centre, fitted), 0.0, 1.0)

    return score


def fit_on_labels(measured: DataFrame, labels: DataFrame, folds: int, fold: int, **settings):
    """The scorer from the labels of documents outside the held-out fold."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    return fit_quality(measured.filter(~held_out(F.col("doc_id"), folds, fold)).join(known, "doc_id"), **settings)


def _scores(score, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), 0.5) if score is None else score(x)


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, limit: float = 0.3, **settings) -> DataFrame:
    """The rows with a score of at least ``limit``, with all columns."""
    measured = cut_lineage(document_statistics(docs))
    score = fit_on_labels(measured, labels, folds, fold, **settings)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics_of(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(_scores(score, x) >= limit, pa.bool_()))
        hand_back()

    return docs.mapInArrow(keep, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, limit: float = 0.3, **settings) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Learns from labels of rows whose crc32(doc_id as text) mod ``folds`` is not ``fold``.
    Repeated labels of a document are averaged; labels that are null or of no document teach
    nothing. Null texts are scored like empty ones. Without labels every score is 0.5. Repeated
    rows are scored each; an empty table gives an empty result; other columns are ignored.
    """
    k = len(STATISTICS)
    measured = cut_lineage(document_statistics(docs))
    score = fit_on_labels(measured, labels, folds, fold, **settings)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, k)
            s = _scores(score, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= limit).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = measured.mapInArrow(judge, f"doc_id {kind}, score double, predicted int")
    return judged.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
