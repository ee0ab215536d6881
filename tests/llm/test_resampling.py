"""Importance resampling against counting with regular expressions, and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from fileledger.llm import oracles, resampling

SCHEMA = "doc_id long, text string, bucket int, n int, rank string, weight string, score int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, least=20):
    s, t = (Counter(f % buckets for x in texts for f in features(x, longest)) for texts in ([x for _, x in rows], target))
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    scored = []
    for i, x in rows:
        f = features(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(k % buckets) for k in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((len(words(x)) < least, -score, i is None, i or 0, weight, len(f)))
    scored.sort()
    drawn = 10 * sum(not r[0] for r in scored) // 100
    return sorted((-1 if r[2] else r[3], r[5], r[4], -r[1], n + 1 if n < drawn else 0) for n, r in enumerate(scored))


def plain(rows):
    return sorted((-1 if i is None else i, n, w, s, r or 0) for i, n, w, s, r in rows)


@pytest.fixture(scope="module")
def rows():
    vocabulary = ["Alpha", "beta", "GAMMA", "delta42", "épée", "naïve", "x", "漢字"]
    out = [(i, " ".join(vocabulary[(i * k + k * k) % len(vocabulary)] for k in range(i % 60)) + ".") for i in range(300)]
    return out + [(300, None), (301, ""), (302, " \n,;"), (303, "Alpha-beta " * 9000), (5, out[5][1]), (44, out[44][1]), (44, out[44][1]), (None, "no id " * 30), (None, "x " * 40), (304, "w" * 20000)]


TARGET = ["alpha GAMMA alpha", "épée; épée", None, "", "unseen"]


def frames(spark, rows, target):
    docs = spark.createDataFrame([(i, t, 1, 2, "r", "w", 3) for i, t in rows], SCHEMA).repartition(4)
    return docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 10_000), (3, 50)])
def test_scores_and_draw(spark, rows, longest, buckets):
    got = resampling.resample(*frames(spark, rows, TARGET), longest=longest, buckets=buckets)
    assert plain(map(tuple, got.collect())) == brute(rows, TARGET, longest, buckets)


def test_sql(rows):
    db = duckdb.connect()
    db.register("given", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    db.register("target", pd.DataFrame({"text": TARGET}))
    db.execute("create view documents as select * from given")
    db.execute("create view benchmark as select * from target")
    assert plain(db.execute(oracles.RESAMPLING).fetchall()) == brute(rows, TARGET)


def test_without_rows(spark, rows):
    assert resampling.resample(*frames(spark, [], TARGET)).count() == 0
    got = resampling.resample(*frames(spark, rows[:40], []), longest=1)
    assert plain(map(tuple, got.collect())) == brute(rows[:40], [])


def test_chained_hashes_are_those_of_joined_words():
    w = [b"a", b"bc", "é".encode(), b"d"]
    assert resampling.feature_hashes(w, 3) == [zlib.crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(4 - n + 1)]
    assert resampling.feature_hashes([], 3) == [] and resampling.feature_hashes(w[:1], 3) == [zlib.crc32(b"a")]
