"""The learned operators against plain versions of their formulas, and the stages of the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fileledger.llm import quality, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def junk(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["###", "$$$", "BUY|", "100%", "alpha"]) for _ in range(n))


# --- quality -------------------------------------------------------------------


def plain_statistics(text):
    data, words = text.encode(), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda test: sum(map(test, data)) / max(1, len(data))
    big, small = (sum(low <= b <= high for b in data) for low, high in ((65, 90), (97, 122)))
    alnum = lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122
    n = max(1, len(words))
    return [
        math.log(1 + len(data)), math.log(1 + len(words)), math.log(1 + len(lines)), sum(len(w) for w in words) / n,
        big / max(1, big + small), share(lambda b: 48 <= b <= 57), share(lambda b: 32 < b < 127 and not alnum(b)),
        share(lambda b: chr(b) in "#$%&*@^~<>=+_\\{}[]"), share(lambda b: b == ord("|")), share(lambda b: b in b"\t\n\x0b\x0c\r "),
        len(set(words)) / n**0.8, max(Counter(words).values(), default=0) / n, sum(words[i] == words[i - 1] for i in range(1, len(words))) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(w[-1] in "!#$%&*@^~|+=<>" for w in words) / n,
        len(zlib.compress(data, 1)) / max(1, len(data)),
    ]


@pytest.mark.parametrize("text", ["", "One two two.\n\nTHREE |#|\n\nOne two two.", prose(1, 300), junk(2, 80), "ü\x0b漢 字!", "word " * 9000])
def test_statistics(text):
    assert quality.statistics_of(text) == pytest.approx(plain_statistics(text))


def plain_isotonic(y, w):
    """min over the right ends of max over the left ends of block means."""
    n = len(y)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_isotonic_is_the_max_min_formula():
    rng = np.random.default_rng(3)
    for _ in range(20):
        y, w = rng.normal(size=14), rng.integers(1, 5, 14).astype(float)
        assert np.allclose(quality.isotonic(y, w), plain_isotonic(y, w))


def test_quality_scores_are_ridge_solutions_calibrated_on_unseen_folds(spark):
    rows = [(i, prose(i, 20 + i % 50) if i % 3 else junk(i, 10 + i % 30)) for i in range(160)]
    rows += [(200, None), (201, ""), (5, rows[5][1])]  # a repeated row
    docs = spark.createDataFrame([(i, t, 1.0, "y") for i, t in rows], "doc_id long, text string, y double, fold string")
    label = {i: int(i % 3 > 0) ^ (i % 17 == 0) for i in range(160)}
    labels = spark.createDataFrame([(i, y, 0, "x") for i, y in label.items()] + [(7, 1 - label[7], 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in quality.score_quality(docs, labels, features=24).collect())

    y = {**label, 7: 0.5}
    train = [(i, t) for i, t in rows if i in y and zlib.crc32(str(i).encode()) % 5 != 0]
    x = np.array([plain_statistics(t or "") for _, t in train])
    target = np.array([float(y[i]) for i, _ in train])
    k = x.shape[1]
    rng = np.random.default_rng(7)
    w, b = rng.normal(0, 1 / math.sqrt(k), (k, 24)), rng.uniform(0, 2 * math.pi, 24)
    mean, spread = x.mean(0), x.std(0)
    spread[spread <= 1e-9] = 1

    def features(x):
        z = np.clip((x - mean) / spread, -6, 6)
        return np.array([[math.sqrt(2 / 24) * math.cos(row @ w[:, j] + b[j]) for j in range(24)] + [1.0] for row in z])

    z = features(x)

    def ridge(own):
        return np.linalg.solve(z[own].T @ z[own] + 1e-3 * own.sum() * np.eye(25), z[own].T @ target[own])

    ids = spark.createDataFrame([(i,) for i, _ in train], "doc_id long").select(F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("f"))
    fold = np.array([r.f for r in ids.collect()])
    raw = np.array([z[i] @ ridge(fold != fold[i]) for i in range(len(train))])
    bins = np.floor(np.clip(raw, -1, 2) * 400).astype(int)
    centre = np.array(sorted(set(bins)))
    n = np.array([(bins == c).sum() for c in centre], float)
    fitted = plain_isotonic(np.array([target[bins == c].mean() for c in centre]), n)
    final = ridge(np.ones(len(train), bool))
    want = np.clip(np.interp(features(np.array([plain_statistics(t or "") for _, t in rows])) @ final, (centre + 0.5) / 400, fitted), 0, 1)
    expected = sorted((i, zlib.crc32(str(i).encode()) % 5 == 0, s, int(s >= 0.3)) for (i, _), s in zip(rows, want, strict=True))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert np.allclose([g[2] for g in got], [e[2] for e in expected], atol=1e-6)


# --- toxicity ------------------------------------------------------------------


def test_cautious_log_odds(spark):
    df = spark.createDataFrame([(9, 1), (0, 40), (3, 0), (30, 400)], "t int, c int")
    for r in df.select("t", "c", toxicity.cautious_log_odds(F.col("t"), F.col("c"), 40.0, 500.0).alias("s")).collect():
        prior = (r.t + r.c) * toxicity.PRIOR_DOCUMENTS / 540 + toxicity.FLAT
        a, b = r.t + prior, r.c + prior
        odds = lambda x, n: x / max(n + toxicity.PRIOR_DOCUMENTS + 1 - x, toxicity.FLAT)
        assert r.s == pytest.approx(math.log(odds(a, 40) / odds(b, 500)) - toxicity.CAUTION * math.sqrt(1 / a + 1 / b))


@pytest.mark.parametrize("seed", range(4))
def test_lambda_solves_the_karlin_altschul_equation(seed):
    rng = random.Random(seed)
    scores = {f"w{i}": rng.uniform(0.7, 5) for i in range(40)}
    clean = {w: rng.randrange(4) for w in scores}
    other, tokens = math.log(1 - toxicity.PASSAGE_SHARE), 20_000.0
    lam = toxicity.rate(scores, other, clean, tokens)
    p = {w: (clean[w] + toxicity.FLAT) / (tokens + 1) for w in scores}
    rest = 1 - sum(p.values())
    assert sum(p[w] * math.exp(lam * s) for w, s in scores.items()) + rest * math.exp(lam * other) == pytest.approx(1, abs=1e-6)
    assert sum(p[w] * s for w, s in scores.items()) + rest * other < 0 < lam


def test_logistic_fit_has_no_better_neighbour():
    bins = np.array([[-4, 90, 1], [-1, 50, 4], [0.5, 30, 9], [3, 20, 18], [7, 40, 40]], float)
    x, n, y = bins.T
    n, y = n + 2 / 5, y + 1 / 5

    def loss(w):
        z = w[0] * x + w[1]
        return (n * np.logaddexp(0, z) - y * z).sum() + 0.5e-3 * (w[0] ** 2 + w[1] ** 2)

    best = np.array(toxicity.logistic(bins))
    for step in np.eye(2) * 1e-3:
        assert loss(best) <= loss(best + step) and loss(best) <= loss(best - step)


def test_passages_are_found_where_they_were_put(spark):
    bad = "vile scum filth".split()
    rows = []
    for i in range(240):
        words = prose(i, 60).split()
        if i % 4 == 0:
            at = i % 40
            words[at:at] = [bad[i % 3], bad[(i + 1) % 3], bad[i % 3], bad[(i + 2) % 3]]
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (0, rows[0][1]), (302, "vile scum " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), 0.0, "s") for i in range(240)], "doc_id long, quality int, toxic int, score double, passages string")
    got = toxicity.score_passages(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 240:
            assert r.predicted == int(r.doc_id % 4 == 0), r
            for p in r.passages:
                found = toxicity.tokens_of(dict(rows)[r.doc_id])[p.first : p.behind]
                assert set(found) & set(bad) and found[0] in bad and found[-1] in bad
        else:
            assert r.predicted == int(r.doc_id == 302)


# --- pipeline --------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(10_000, None, None, None, 0), (10_001, "", "en", None, 0), (None, "the " * 60 + "end", "en", "src1", 0)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def shingle_sets(rows, width):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def test_one_of_near_copies_stays(spark, corpus):
    """Every group by exact Jaccard keeps one row, and rows without company stay."""
    rows = corpus.collect()
    rows += [rows[3], rows[3]]  # repeated rows
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, corpus.schema), "").collect()
    sets = shingle_sets(rows, 5)
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            same = rows[a] == rows[b]
            if same or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    group = {}
    for k, r in enumerate(rows):
        group.setdefault(tuple(r), find(k))
    assert sorted(group[tuple(r)] for r in kept) == sorted({find(k) for k in range(len(rows))})


def test_good_and_identified_rows_are_those_the_operators_name(spark, corpus):
    folder = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in quality.score_quality(corpus, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in corpus_pipeline.keep_quality(spark, corpus, folder).collect()} == good
    known = corpus_pipeline.keep_languages(spark, corpus, folder).collect()
    right = {r.doc_id for r in corpus.collect() if r.lang}
    assert 10_000 not in {r.doc_id for r in known} and 10_001 not in {r.doc_id for r in known}
    assert len(right & {r.doc_id for r in known}) >= 0.95 * len(right - {10_001})
    clashing = corpus.withColumnsRenamed({"source": "score", "n_chars": "x"})
    assert corpus_pipeline.keep_quality(spark, clashing, folder).columns == clashing.columns
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.keep_languages):
        assert stage(spark, corpus.limit(0), folder).count() == 0


def test_mixed_words_come_near_their_targets(spark, corpus):
    count = lambda t: len((t or "").encode().split())
    before, after = Counter(), Counter()
    for r in corpus.collect():
        before[r.source] += count(r.text)
    mixed = corpus_pipeline.mix_sources(spark, corpus, "").collect()
    for r in mixed:
        after[r.source] += count(r.text)
    order = sorted(before, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, share, open_ = {}, 1.5 * sum(before.values()), set(order)
    while open_:
        level = (share - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * before[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * before[s] for s in full}
        open_ -= full
    for s in order:
        assert abs(after[s] - target[s]) <= max(2, 0.002 * target[s]), s
