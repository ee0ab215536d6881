"""The conversation trie against dictionaries of all prefixes, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from fileledger.llm import oracles, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, shard long"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - c % 100, [])[: heads[c]] + own[c][heads[c] :]) for c in own}


def brute(paths):
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def plain(rows):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for c in [*range(0, 60), *range(100, 160), 250, 251]:  # 200 does not exist
        for turn in range(rng.randrange(1, 9)):
            out.append((c, turn, rng.choice(["user", None]), rng.choice(["", "é", "hi", "hello", None])))
    out += [(c, t, "user", "same") for c in range(300, 360) for t in range(3)]  # a hot conversation
    out += [(400, None, "user", "first"), (400, 3, "user", "tie b"), (400, 3, "user", "tie a"), (401, 1, "u", "x"), (401, 1, "u", "x"), (None, 1, "user", "lost")]
    return out + [(402, t, "user", f"long {t} " + "w" * (9000 if t == 7 else 0)) for t in range(150)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 9) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("paths", "piece"), [(1, 7), (9, 50), (20_000, 50_000)])
def test_nodes(spark, rows, monkeypatch, paths, piece):
    monkeypatch.setattr(prefix_trie, "SHARD_PATHS", paths)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    assert plain(prefix_trie.shared_conversation_trie(frame(spark, rows)).collect()) == brute(rebuilt(rows))


def test_sql(spark, rows):
    db = duckdb.connect()
    db.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    db.execute("create view conversations as select * from given")
    found = db.execute(oracles.PREFIX_TRIE).fetchall()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in found) == brute(rebuilt(rows))


def test_without_rows(spark):
    assert prefix_trie.shared_conversation_trie(frame(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(501, 600) if zlib.crc32(str(c).encode()) % 6)
    (root,) = prefix_trie.shared_conversation_trie(frame(spark, [(c, 0, "user", "lost for want of a base")])).collect()
    assert plain([root]) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_children_never_share_a_cell():
    rng = np.random.default_rng(1)
    trie, states, seen = prefix_trie.DoubleArray(4), [0], {0}
    for _ in range(300):
        state = states.pop(int(rng.integers(len(states))))
        letters = np.unique(rng.integers(1, 40, int(rng.integers(1, 9))))
        trie.place(state, letters)
        cells = (trie.base[state] + letters).tolist()
        assert not seen & set(cells) and (trie.check[cells] == state).all()
        seen.update(cells)
        states += cells
