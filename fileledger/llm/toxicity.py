"""Toxicity by maximum-scoring segments.

Token scores are log-odds between toxic and clean labelled documents, shrunk by a Dirichlet
prior. A linear scan finds all maximal scoring segments of a text. Their significance follows
extreme-value statistics (Karlin and Altschul 1990): the number of segments of score S
expected in a clean text of n tokens is K n exp(-lambda S). The evidence of the significant
segments is added up and calibrated to a probability.

A token is a word or the beginning of one (4 to 6 letters), so that inflected and compounded
forms share what is known of their stem. Counts are numbers of documents, and of training
documents with the same least shingle hash one stays: copies would make their own rare words
look telling.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import held_out
from fileledger.session import cut_lineage

TOKEN = re.compile(r"\w+")
STEMS = (4, 5, 6)
#: Labelled rows to learn from, about.
SAMPLE_ROWS = 20_000
#: Weight of the prior: documents at the pooled rate, and half a document for each class.
PRIOR_DOCUMENTS = 10.0
FLAT = 0.5
#: A score is the log-odds less this many standard errors; toxic documents a token needs at least.
CAUTION = 2.5
LEAST_DOCUMENTS = 3
#: Least score that counts: twice as likely in a toxic document.
LEAST_SCORE = math.log(2)
#: Share of telling tokens that a toxic passage is taken to have; it sets the cost of other tokens.
PASSAGE_SHARE = 0.1
#: Expected number of chance segments below which a segment is significant.
SIGNIFICANT = 0.05
HALVES = 2
#: Words whose scores a worker remembers.
REMEMBERED = 400_000


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def forms(word: str) -> list[str]:
    """The word and its stems, the latter with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def document_forms(tokens: list[str]) -> set[str]:
    return {f for w in set(tokens) for f in forms(w)}


def least_shingle(tokens: list[str]) -> int:
    """Least hash of three words in a row; near copies mostly share it."""
    return min((zlib.crc32(" ".join(tokens[i : i + 3]).encode()) for i in range(max(1, len(tokens) - 2))), default=0)


def maximal_segments(items: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, behind the last, score), by Ruzzo and Tompa 1999.

    ``items`` are the positions and scores of the tokens with a score of their own; tokens
    between them score ``other``, which is not positive, so a run of them is one step.
    """
    found: list[tuple[int, int, float, float]] = []  # first, behind, sum before, sum after
    total, behind = 0.0, 0
    for at, score in items:
        total += other * (at - behind)
        behind = at + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, left, right = at, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((first, behind, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


def cautious_log_odds(toxic: Column, clean: Column, n1: float, n0: float) -> Column:
    """Log-odds of a token between ``n1`` toxic and ``n0`` clean documents, CAUTION errors towards 0."""
    prior = (toxic + clean) * (PRIOR_DOCUMENTS / (n1 + n0)) + FLAT
    c1, c0 = toxic + prior, clean + prior
    odds1 = c1 / F.greatest(F.lit(n1 + PRIOR_DOCUMENTS + 1) - c1, F.lit(FLAT))
    odds0 = c0 / F.greatest(F.lit(n0 + PRIOR_DOCUMENTS + 1) - c0, F.lit(FLAT))
    return F.log(odds1) - F.log(odds0) - CAUTION * F.sqrt(1 / c1 + 1 / c0)


def without_main_word(counts: DataFrame) -> DataFrame:
    """Take from each stem the documents of its most frequent toxic word.

    A stem then tells only what words beyond that one tell: ``loser`` says nothing about other
    words that begin alike. Input and output: form, t0, t1 (toxic documents), c0, c1 (clean ones).
    """
    names = [f"{k}{h}" for k in "tc" for h in range(HALVES)]
    words = counts.filter("form not like '%*' and form not like ' %'")
    stems = F.array(*[F.when(F.length("form") > k, F.concat(F.substring("form", 1, k), F.lit("*"))) for k in STEMS])
    main = words.select(F.explode(F.array_compact(stems)).alias("form"), F.struct((F.col("t0") + F.col("t1")).alias("t"), F.col("form").alias("word"), *names).alias("main"))
    main = main.groupBy("form").agg(F.max("main").alias("main"))
    rest = [F.greatest(F.lit(0), F.col(n) - F.coalesce(F.col(f"main.{n}"), F.lit(0))).alias(n) for n in names]
    return counts.join(main, "form", "left").select("form", *rest)


def rate(scores: dict[str, float], other: float, clean: dict[str, int], tokens: float) -> float:
    """Lambda: the positive root of the sum of p exp(lambda s) = 1 over the tokens of clean texts."""
    pairs = [((clean[t] + FLAT) / (tokens + 1), s) for t, s in scores.items()]
    if not pairs:
        return 1.0
    p, s = (np.array(x) for x in zip(*pairs, strict=True))
    p = p / max(1.0, 2 * p.sum())
    f = lambda x: (p * np.exp(np.minimum(500.0, x * s))).sum() + (1 - p.sum()) * math.exp(x * other) - 1
    low, high = 1e-3, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return max(1e-3, (low + high) / 2)


class Segments:
    """Token scores with their extreme-value constants; finds the passages of a text."""

    def __init__(self, scores: dict[str, float], lam: float, log_k: float = 0.0) -> None:
        self.scores, self.lam, self.log_k = scores, lam, log_k
        self.other = math.log(1 - PASSAGE_SHARE)
        self.words: dict[str, float] = {}

    def word_score(self, word: str) -> float:
        return max((self.scores.get(f, 0.0) for f in forms(word)), default=0.0)

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """All maximal segments with their evidence, lambda S - ln(K n)."""
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        scores = list(map(known.get, tokens))
        if None in scores:
            for w in set(tokens):
                if w not in known:
                    known[w] = self.word_score(w)
            scores = list(map(known.get, tokens))
        if not any(scores):
            return []
        items = [(i, s) for i, s in enumerate(scores) if s]
        length = self.log_k + math.log(len(tokens))
        return [(a, b, self.lam * s - length) for a, b, s in maximal_segments(items, self.other)]

    def evidence(self, passages: list[tuple[int, int, float]], tokens: int) -> float:
        """Sum over the significant passages; else the best there is."""
        strong = [e for _, _, e in passages if math.exp(-e) <= SIGNIFICANT]
        return sum(strong) if strong else max((e for _, _, e in passages), default=-self.log_k - math.log(max(1, tokens)))


def logistic(bins: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a logistic fit to rows (evidence, rows, positive rows)."""
    x, n, y = bins.T
    # One row of each label, spread over the bins, keeps the fit finite.
    n, y = n + 2 / len(x), y + 1 / len(x)
    w = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - n * p) - 1e-3 * w
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), grad)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_toxicity(train: DataFrame) -> tuple[Segments, tuple[float, float]] | None:
    """The segment scorer and the calibration, from (doc_id, text, y); None without both labels.

    Two halves score each other, so that the constants rest on texts a half has not seen.
    """
    spark = train.sparkSession
    labelled = train.select("text", (F.col("y") >= 0.5).cast("int").alias("y"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingle = [least_shingle(tokens_of(t.as_py() or "")) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shingle, pa.int64())], ["text", "y", "shingle"])

    marked = labelled.mapInArrow(mark, "text string, y int, shingle long").dropDuplicates(["y", "shingle"])
    halved = cut_lineage(marked.select("text", "y", F.pmod(F.xxhash64("shingle"), F.lit(HALVES)).cast("int").alias("half")))

    def count_forms(batches: Iterator[pa.RecordBatch], only=None) -> Iterator[pa.RecordBatch]:
        found, wanted = [Counter() for _ in range(HALVES)], only.value if only else None
        sizes = np.zeros((HALVES, 2), np.int64)
        for batch in batches:
            for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = tokens_of(text or "")
                own = document_forms(tokens)
                found[half].update(own if wanted is None else own & wanted)
                sizes[half] += 1, len(tokens)
        flat = [(h, f, n) for h, c in enumerate(found) for f, n in c.items()]
        flat += [(h, name, int(n)) for h in range(HALVES) for name, n in zip((" documents", " tokens"), sizes[h], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat, strict=True)], ["half", "form", "n"])

    def by_half(counted: DataFrame, name: str) -> DataFrame:
        return counted.groupBy("form").agg(*[F.coalesce(F.sum(F.when(F.col("half") == h, F.col("n"))), F.lit(0)).alias(f"{name}{h}") for h in range(HALVES)])

    shape = "half long, form string, n long"
    toxic = by_half(halved.filter("y = 1").mapInArrow(lambda b: count_forms(b), shape), "t")
    toxic = cut_lineage(toxic.filter(F.col("t0") + F.col("t1") >= LEAST_DOCUMENTS))
    # Forms of the bounded sample only.
    names = spark.sparkContext.broadcast(frozenset(r[0] for r in toxic.select("form").collect()))
    clean = by_half(halved.filter("y = 0").mapInArrow(lambda b: count_forms(b, names), shape), "c")
    both = cut_lineage(toxic.join(clean, "form", "left").na.fill(0))
    sizes = {r["form"].strip(): r for r in both.filter("form like ' %'").collect()}
    if "documents" not in sizes or not all(sum(sizes["documents"][f"{k}{h}"] for h in range(HALVES)) for k in "tc"):
        return None
    models: list[Segments] = []
    both = cut_lineage(without_main_word(both))
    for halves in ([1], [0], [0, 1]):
        t, c = (sum((F.col(f"{k}{h}") for h in halves), F.lit(0)) for k in "tc")
        n1, n0 = (float(sum(sizes["documents"][f"{k}{h}"] for h in halves)) for k in "tc")
        score = cautious_log_odds(t, c, n1, n0) if n1 and n0 else F.lit(0.0)
        telling = both.filter("form not like ' %'").select("form", score.alias("score"), c.alias("clean")).filter(F.col("score") > LEAST_SCORE).collect()
        scores = {r["form"]: r["score"] for r in telling}
        tokens = float(sum(sizes["tokens"][f"c{h}"] for h in halves))
        models.append(Segments(scores, rate(scores, math.log(1 - PASSAGE_SHARE), {r["form"]: r["clean"] for r in telling}, tokens)))
    *apart, final = models
    others = spark.sparkContext.broadcast([(m.scores, m.lam) for m in apart])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Segments(*m) for m in others.value]
        for batch in batches:
            rows = []
            for text, y, half in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens, scorer = tokens_of(text or ""), scorers[half]
                found = scorer.passages(tokens)
                rows.append((y, scorer.evidence(found, len(tokens)), max((e for _, _, e in found), default=-math.log(max(1, len(tokens))))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["y", "evidence", "best"])

    scored = cut_lineage(halved.mapInArrow(unseen, "y long, evidence double, best double"))
    # The best segment of a clean text follows a Gumbel law with mean ln K + Euler's constant.
    mean = scored.filter("y = 0").agg(F.avg("best")).first()[0]
    final.log_k = (mean if mean is not None else 0.0) - 0.5772156649
    width = 0.25
    shifted = F.greatest(F.lit(-30.0), F.least(F.lit(60.0), F.col("evidence") - F.lit(final.log_k)))
    bins = scored.groupBy(F.floor(shifted / width).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    table = np.array(sorted(((r["bin"] + 0.5) * width, r["n"], r["y"]) for r in bins), dtype=float)
    return final, logistic(table)


def score_passages(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, limit: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the significant passages of the text.

    A passage has its first token, the token behind its last, and its evidence. Learns from
    labels of rows whose crc32(doc_id as text) mod ``folds`` is not ``fold``, from about
    ``rows`` of them. Repeated labels are averaged. Null and empty texts have no passage and the
    score of a text of one token. Without labels of both kinds every score is 0. Repeated rows
    are scored each; an empty table gives an empty result; other columns are ignored.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("y"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < F.lit(1_000_000.0 * rows / n))
    # About ``rows`` ids at most, so that only their texts are moved.
    fitted = fit_toxicity(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")) if n else None
    plain = fitted and ((fitted[0].scores, fitted[0].lam, fitted[0].log_k), fitted[1])
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, (slope, constant) = shared.value or (None, (0.0, 0.0))
        model = Segments(*parts) if parts else None
        passage = pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32()), ("evidence", pa.float64())]))
        for batch in batches:
            score, spans = [], []
            for value in batch.column(1):
                if model is None:
                    score.append(0.0), spans.append([])
                    continue
                tokens = tokens_of(value.as_py() or "")
                found = model.passages(tokens)
                e = max(-30.0, min(60.0, model.evidence(found, len(tokens))))
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, slope * e + constant)))))
                spans.append([{"first": a, "behind": b, "evidence": x} for a, b, x in found if math.exp(-x) <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= limit) for s in score], pa.int32()), pa.array(spans, passage)],
                ["doc_id", "score", "predicted", "passages"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, score double, predicted int, passages array<struct<first:int,behind:int,evidence:double>>")
    return judged.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted", "passages")
