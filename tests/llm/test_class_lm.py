"""The class-based language model against plain counting and a plain model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fileledger.llm import class_lm
from fileledger.llm.common import held_out

SCHEMA = "doc_id long, text string, held_out boolean, score int, block string, word int"


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def learns(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 != 0


def table(spark, rows):
    return spark.createDataFrame([(i, t, True, 1, "b", 2) for i, t in rows], SCHEMA).repartition(3)


def scores(df, **kw):
    return class_lm.class_scores(df, held_out(F.col("doc_id"), 10, 0), **kw)


def sentences(n, start=0):
    """Two tongues of a few words each, whose articles and nouns alternate."""
    rng = np.random.default_rng(start)
    out = []
    for i in range(n):
        a, b = (("the", "a"), [f"noun{k}" for k in range(30)]) if rng.random() < 0.5 else (("le", "un"), [f"mot{k}" for k in range(30)])
        out.append((start + i, " ".join(f"{rng.choice(a)} {rng.choice(b)}" for _ in range(1 + int(rng.integers(20))))))
    return out


def plain_bigram(rows, of, classes):
    """Log-probabilities by the written-out formula, for classes given word by word."""
    count, kinds, size, moves = Counter(), Counter(), Counter(), Counter()
    train = [tokens(t) for i, t in rows if learns(i)]
    for t in train:
        count.update(t)
    state = lambda w: classes if w is None else of[w] if count[w] else classes + 1
    for w, n in count.items():
        kinds[state(w)] += w is not None
        size[state(w)] += n
    for t in train:
        for before, w in zip([None, *t], t, strict=False):
            moves[state(before), state(w)] += 1
            if before is not None and count[before] == 1:
                moves[classes + 1, state(w)] += 1
    d = class_lm.DISCOUNT
    total, weight = sum(size.values()), class_lm.SHARE_WEIGHT

    def move(a, b):
        return (moves[a, b] + weight * size[b] / total) / (sum(moves[a, c] for c in range(classes + 1)) + weight)

    def p(before, w):
        a, b = state(before), state(w)
        if b == classes + 1:
            return sum(move(a, c) * d * kinds[c] / size[c] for c in range(classes) if size[c])
        return move(a, b) * (1 if w is None else (count[w] - d) / size[b])

    return count, p


@pytest.fixture(scope="module")
def rows():
    return [*sentences(150), (900, None), (901, ""), (902, " \n\t"), (903, "Unknownword THE"), (None, "no id"), (5, "the noun1"), (5, "the noun1"),
            (904, "le " * 5000), (905, "ÀÉ le"), (906, "x" * 9000)]


def test_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 700)  # many blocks
    df = table(spark, rows)
    held = held_out(F.col("doc_id"), 10, 0)
    blocks = class_lm.token_blocks(df, held)
    assert blocks.count() > 6
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6), r.held_out, r.train_tokens)
                 for r in scores(df, classes=6, core_share=0.02).collect())

    # The classes that the operator found, word by word.
    n = sum(len(tokens(t)) for i, t in rows if learns(i))
    core = class_lm.core_words(blocks, 0.02, n * 0.02)
    count = Counter(w for i, t in rows if learns(i) for w in tokens(t))
    assert core == {w: c for w, c in count.items() if w is not None and c >= n * 0.02}
    of, classes_table = class_lm.exchange(class_lm.core_bigrams(blocks, core), 6)
    found = dict(zip(core, of.tolist(), strict=True))
    listed = {r.block: class_lm.word_list(r.words) for r in blocks.select("block", "words").collect()}
    others = class_lm.other_words(blocks, core, of, classes_table, 6).collect()
    for r in others:
        word = listed[r.block][r.at]
        assert word not in core and r.n == count[word]
        assert found.setdefault(word, r["class"]) == r["class"]
    assert sum(r.lead for r in others) == len({listed[r.block][r.at] for r in others})
    gains = class_lm.context_gains(classes_table, 6)
    around = {}
    for i, t in rows:
        line = [None, *tokens(t)]
        for k, w in enumerate(line[1:-1], 1):
            if learns(i) and w not in core:
                vector = around.setdefault(w, np.zeros(16))
                for side, x in ((0, line[k - 1]), (8, line[k + 1])):
                    vector[side + (7 if x is None else found[x] if x in core else 6)] += 1
    for w, vector in around.items():
        gain = vector @ gains
        assert gain[found[w]] == pytest.approx(gain.max())

    count, p = plain_bigram(rows, found, 6)
    total, distinct = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        line = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in line)
        score = sum(math.log10(p(a, b)) for a, b in zip([None, *line], line, strict=False))
        want.append((i if i is not None else -1, len(line), sum(count[w] > 0 for w in line), round(base, 6), round(score, 6), not learns(i), total))
    assert [x[:3] + x[5:] for x in got] == [x[:3] + x[5:] for x in sorted(want)]
    assert np.allclose([x[3:5] for x in got], [x[3:5] for x in sorted(want)], atol=2e-5)
    # A probability distribution over all known words, the end and the unknown word.
    for before in (None, b"the", b"le", b"never seen"):
        assert sum(p(before, w) for w in [*count, b"never seen"]) == pytest.approx(1)


def test_better_than_words_alone(spark):
    held = scores(table(spark, sentences(400, 1000)), classes=6).filter("held_out").collect()
    assert len(held) > 20 and all(r.score > r.base_score for r in held if r.n_tokens > 5)


def test_exchange_reaches_a_maximum_and_parts_the_tongues():
    words = ["the", "a", "le", "un", *[f"noun{k}" for k in range(8)], *[f"mot{k}" for k in range(8)]]
    table = np.zeros((22, 22))
    for _, t in sentences(400):
        line = [21, *[words.index(w) if w in words else 20 for w in t.split()], 21]
        np.add.at(table, (line[:-1], line[1:]), 1)

    def likelihood(of):
        member = np.eye(8)[np.append(of, [6, 7])]
        t = member.T @ table @ member
        return class_lm.x_log_x(t).sum() - class_lm.x_log_x(t.sum(0)).sum() - class_lm.x_log_x(t.sum(1)).sum()

    of, classes_table = class_lm.exchange(table, 6)
    member = np.eye(8)[np.append(of, [6, 7])]
    assert np.allclose(classes_table, member.T @ table @ member)
    for w in range(len(of)):  # no word can move to a better class
        for k in range(6):
            assert likelihood(np.where(np.arange(len(of)) == w, k, of)) <= likelihood(of) + 1e-6
    assert not set(of[4:12]) & set(of[12:])


def test_large_counts_are_split():
    pair = np.repeat([5, 7, 12], [3, 1, 9])
    class_lm.COUNT_BITS, bits = 2, class_lm.COUNT_BITS
    try:
        word, context = class_lm.packed_contexts(pair, 10)
    finally:
        class_lm.COUNT_BITS = bits
    found = Counter()
    for w, c in zip(word.tolist(), context.tolist(), strict=True):
        found[w, c >> 2] += c & 3
    assert found == {(0, 5): 3, (0, 7): 1, (1, 2): 9}


def test_nothing_to_learn(spark, rows):
    assert scores(table(spark, [])).count() == 0
    (row,) = scores(table(spark, [(next(i for i in range(99) if not learns(i)), "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    (row,) = scores(table(spark, [(None, None)])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 1, 1) and row.score == 0.0
