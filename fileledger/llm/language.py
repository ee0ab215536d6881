"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces (forward algorithm);
a text's is the product over its words. Probabilities are learned by expectation
maximisation, with expected piece counts from forward and backward sums over the word counts
of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import hand_back, held_out, tokenizer_file
from fileledger.session import cut_lineage

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled rows to learn from, by language.
SAMPLE_ROWS = 500
#: Probability of a character that is no piece of the vocabulary, in any language.
UNKNOWN = 1e-7
#: Least probability of a piece, and length up to which the sums of a word stay in the range of
#: a double; those of longer words are kept as logarithms.
LEAST_PROBABILITY = 1e-9
LONGEST_PLAIN = 30
#: Distinct words whose probabilities a worker remembers; texts whose new words are summed together.
REMEMBERED = 400_000
TOGETHER = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model_file: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary without case, of any length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in map(sp.id_to_piece, ids) if p and p == p.lower()})


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def _hashes(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each piece length the hash of every substring of that length, by its start."""
    h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(1, min(longest, codes.shape[1]) + 1):
        h = h[:, :-1] * _STEP + codes[:, k - 1 :]
        yield h


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)


class Pieces:
    """Piece probabilities by language (rows of ``table``), and the sums over segmentations.

    Words of one length are worked on together, position by position.
    """

    def __init__(self, names: list[str], table: np.ndarray) -> None:
        self.absent = len(names)
        self.table = np.vstack([table.T, np.zeros(table.shape[0])])
        self.longest = max(map(len, names), default=1)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, self.longest + 1):
            own = [i for i, p in enumerate(names) if len(p) == k]
            if own:
                *_, h = _hashes(_codes([names[i] for i in own], k), k)
                order = np.argsort(h[:, 0])
                self.by_length[k] = h[order, 0], np.array(own)[order]

    def places(self, codes: np.ndarray) -> list[np.ndarray]:
        """By piece length: the piece at each start, or ``absent``."""
        out = []
        for k, h in enumerate(_hashes(codes, self.longest), 1):
            known, piece = self.by_length.get(k, (np.zeros(1, np.uint64), np.array([self.absent])))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            out.append(np.where(known[at] == h, piece[at], self.absent))
        return out

    def weights(self, place: np.ndarray, k: int, languages: slice) -> np.ndarray:
        p = self.table[place, languages]
        return np.where((place == self.absent)[..., None], UNKNOWN, p) if k == 1 else p

    def sums(self, places: list[np.ndarray], languages: slice, logs: bool) -> list[np.ndarray]:
        """Forward sums: by end, the probability of all segmentations up to there, or its logarithm."""
        n = places[0].shape[1]
        fore = [(np.zeros_like if logs else np.ones_like)(self.table[places[0][:, 0], languages])]
        for end in range(1, n + 1):
            steps = range(1, min(len(places), end) + 1)
            parts = ((fore[end - k], self.weights(places[k - 1][:, end - k], k, languages)) for k in steps)
            fore.append(log_sum(parts) if logs else sum(f * w for f, w in parts))
        return fore

    def backward(self, places: list[np.ndarray], languages: slice, logs: bool) -> list[np.ndarray]:
        """By start, the probability of all segmentations from there on, or its logarithm."""
        n = places[0].shape[1]
        empty = (np.zeros_like if logs else np.ones_like)(self.table[places[0][:, 0], languages])
        back = [empty] * (n + 1)
        for start in range(n - 1, -1, -1):
            steps = range(1, min(len(places), n - start) + 1)
            parts = ((back[start + k], self.weights(places[k - 1][:, start], k, languages)) for k in steps)
            back[start] = log_sum(parts) if logs else sum(b * w for b, w in parts)
        return back

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each language."""
        out = np.zeros((len(words), self.table.shape[1]))
        for length, owner, marked in by_length(words):
            logs = length > LONGEST_PLAIN
            last = self.sums(self.places(_codes(marked, length)), slice(None), logs)[-1]
            out[owner] = last if logs else np.log(last)
        return out

    def expected(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected uses of each piece in words of one language, ``counts`` times each."""
        out, own = np.zeros(self.absent + 1), slice(language, language + 1)
        for length, owner, marked in by_length(words):
            logs = length > LONGEST_PLAIN
            places = self.places(_codes(marked, length))
            fore, back = self.sums(places, own, logs), self.backward(places, own, logs)
            for k, place in enumerate(places, 1):
                for start in range(place.shape[1]):
                    w, f, b = self.weights(place[:, start], k, own), fore[start], back[start + k]
                    use = w * np.exp(f + b - fore[-1]) if logs else f * w * b / fore[-1]
                    out += np.bincount(place[:, start], use[:, 0] * counts[owner], self.absent + 1)
        return out[:-1]


def log_sum(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logarithm of the sum of exp(a) * w over the parts (a, w)."""
    exponents, weights = map(np.stack, zip(*parts, strict=True))
    top = np.where(weights > 0, exponents, -np.inf).max(0)  # a piece of one character always counts
    return top + np.log((np.exp(np.minimum(exponents - top, 0)) * weights).sum(0))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """The words with their start marks by length, and their numbers."""
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for i, w in enumerate(words):
        owner, marked = groups.setdefault(len(w) + 1, ([], []))
        owner.append(i), marked.append("▁" + w)
    for length, (owner, marked) in groups.items():
        yield length, np.array(owner), marked


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of each language, all of them where there are fewer, by a hash of the row."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return docs.select("lang", "text")
    # One rate per language, as the model has a column for each; no text is moved for it.
    rates = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 1_000_000.0 * rows / r["n"])])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))
    return docs.filter(draw < F.element_at(rates, F.col("lang"))).select("lang", "text")


#: Languages, pieces, and the probability of each piece in each language (languages by pieces).
Model = tuple[list[str], list[str], np.ndarray]


def fit_pieces(train: DataFrame, vocabulary_file: str | None = None, rows: int = SAMPLE_ROWS, rounds: int = 3) -> Model:
    """Languages in code point order and the piece probabilities, from (doc_id, text, lang).

    Rows without a language or a text teach nothing.
    """
    spark = train.sparkSession
    sample = _sample(train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), rows)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
            flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat, strict=True)], ["lang", "word", "n"])

    counted = sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    names = vocabulary(vocabulary_file or tokenizer_file("piece_bpe_32k.model"))
    table = np.full((len(languages), len(names)), 1.0 / len(names))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((languages, names, table))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            languages, names, table = shared.value
            model, found = Pieces(names, table), np.zeros(table.shape)
            for batch in batches:
                lang = np.array(batch.column(0).to_pylist())
                for i, name in enumerate(languages):
                    own = batch.filter(pa.array(lang == name))
                    if len(own):
                        found[i] += model.expected(own.column(1).to_pylist(), own.column(2).to_numpy().astype(float), i)
            at, piece = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(piece), pa.array(found[at, piece])], ["at", "piece", "n"])

        # At most one number per piece and language comes back, whatever the corpus size.
        sums = counted.mapInArrow(expect, "at long, piece long, n double").groupBy("at", "piece").agg(F.sum("n").alias("n"))
        table = np.zeros(table.shape)
        for r in sums.collect():
            table[r["at"], r["piece"]] = r["n"]
        # The part of a language's mass that follows all languages together keeps unseen pieces possible.
        pooled, mass = table.sum(0) + 0.01, np.maximum(table.sum(1, keepdims=True), 1.0)
        table = np.maximum((table + 0.01 * mass * pooled / pooled.sum()) / (1.01 * mass), LEAST_PROBABILITY)
    return languages, names, table


class Identifier:
    """Judges whole texts, with a bounded memory of words."""

    def __init__(self, languages: list[str], names: list[str], table: np.ndarray) -> None:
        self.languages = languages
        self.model = Pieces(names, table) if languages else None
        self.known: dict[str, int] = {}
        self.rows = np.empty((1024, max(1, len(languages))))

    def learn(self, words: set[str]) -> None:
        new = list(words - self.known.keys())
        while len(self.known) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        if new:
            first = len(self.known)
            self.rows[first : first + len(new)] = self.model.log_probabilities(new)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def judge(self, words: list[str]) -> tuple[str, float]:
        if not words:
            return "und", 0.0
        # Mean over the words: odds of a typical word, comparable between lengths.
        mean = self.rows[list(map(self.known.get, words))].sum(0) / len(words)
        first = int(mean.argmax())
        return self.languages[first], float(1.0 / np.exp(mean - mean[first]).sum())

    def __call__(self, texts: pa.Array) -> Iterator[tuple[str, float]]:
        for start in range(0, len(texts), TOGETHER):
            read = [words_of(t.as_py() or "") for t in texts[start : start + TOGETHER]]
            read = [w if self.languages and has_letter(w) else [] for w in read]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn(set().union(*read))
            yield from map(self.judge, read)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(*shared.value)
        for batch in batches:
            best, score = zip(*identifier(batch.column(1)), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose language is determined with a score of at least ``least``, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in identifier(batch.column(at))], pa.bool_()))
        del identifier
        hand_back()

    return docs.mapInArrow(keep, docs.schema)


def predict_language(docs: DataFrame, folds: int = 4, fold: int = 2, **settings) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Learns from rows with a language whose crc32(doc_id as text) mod ``folds`` is not
    ``fold``. ``und`` with score 0 where the text is null or has no letter, or where no
    language could be learned. The score is the share of the predicted language in the odds
    of a typical word: near 1 for a clear text, one part in the number of languages where
    nothing speaks for any. Repeated rows are judged each; an empty table gives an empty
    result; other columns are ignored.
    """
    out = held_out(F.col("doc_id"), folds, fold)
    judged = identify(docs, fit_pieces(docs.select("doc_id", "text", "lang").filter(~out), **settings))
    return judged.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
