"""A trie of conversations over double arrays (Aoe 1989), sharded by prefix.

A conversation is the path of its turns, each named by 128 bits of role and text. Equal paths
become one row with the number of their conversations. Distinct paths are range-sorted, and a
shard is a run of consecutive ones: of their turns it makes dense ids, packs BASE and CHECK
arrays over them, and walks these for the nodes. However many conversations share a turn, their
paths spread over shards.

Of a shard, only nodes on its first and last path can belong to other shards too. These upper
nodes are few; they are merged by the hash of their path, and the sums over subtrees go on
from what each shard has closed below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import shuffle_partitions
from fileledger.session import cut_lineage

#: Hexadecimal digits that name a turn.
NAME = 32
#: Paths and turns at which a shard ends; a shard is in memory as a whole.
SHARD_PATHS = 20_000
SHARD_TURNS = 400_000
#: Conversation ids that travel as one piece to the hash of a node's ends.
PIECE = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Free cells tried for a node's children before they go behind the last used cell.
TRIES = 32


def turn_name(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, turns (name, chars) in order of turn, null first.

    Only names and sizes of the turns are gathered, never their texts. Equal turns follow their
    names; repeated rows are turns of their own. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id",
        F.struct(
            F.col("turn").isNotNull().alias("dated"), "turn", turn_name(role, text).alias("name"),
            F.length(text).cast("long").alias("chars"),
        ).alias("turn"),
    )
    turns = F.sort_array(F.collect_list("turn"))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["name"].alias("name"), t["chars"].alias("chars"))).alias("turns")
    )


def shared_heads(conversations: DataFrame, group: int = 100, longest: int = 6) -> DataFrame:
    """Every conversation with its first turns replaced by those of the first of its hundred.

    Of conversation c, the first h = crc32(decimal c) % ``longest`` turns become the first h of
    conversation c - c % ``group``: all of them if it has fewer, none if it does not exist.
    """
    own = cut_lineage(conversations)
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, longest - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    both = own.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    rest = F.slice(F.col("turns"), F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest).alias("turns"))


def hashed_ends(members: DataFrame) -> DataFrame:
    """Per path: n, conv_id (smallest), ends_sha256 of its conversations' ids in order.

    A path may have a third of all conversations. Their ids are range-sorted and packed in
    pieces where they lie; only pieces, few and in order, go through the task that hashes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([seq]), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])],
                ["seq", "first", "n", "ids"],
            )

        for batch in batches:
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (at != seq or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                seq = at
                ids.append(conv)
        if ids:
            yield piece()

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = first = sha = None
        n = 0
        for batch in batches:
            done: list[list] = [[], [], [], []]
            for at, low, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != seq:
                    if seq is not None:
                        for column, value in zip(done, (seq, n, first, sha.hexdigest()), strict=True):
                            column.append(value)
                    seq, first, sha, n = at, low, hashlib.sha256(), 0
                else:
                    sha.update(b",")
                sha.update(ids.encode())
                n += count
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.int64()), pa.array(done[3], pa.string())], ["seq", "n", "conv_id", "ends"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([n], pa.int64()), pa.array([first], pa.int64()), pa.array([sha.hexdigest()])], ["seq", "n", "conv_id", "ends"])

    parts = shuffle_partitions(members.sparkSession)
    ids = members.select("seq", F.col("conv_id").cast("long").alias("conv_id"))
    pieces = ids.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = pieces.mapInArrow(pack, "seq string, first long, n long, ids string")
    pieces = pieces.repartition(parts, "seq").sortWithinPartitions("seq", "first")
    return pieces.mapInArrow(hash_pieces, "seq string, n long, conv_id long, ends string")


class DoubleArray:
    """States as cells: a child by letter c of state s is cell BASE[s] + c, whose CHECK is s."""

    def __init__(self, cells: int) -> None:
        self.base = np.zeros(cells, np.int64)
        self.check = np.full(cells, -1, np.int64)
        self.check[0] = 0
        self.free, self.end = 1, 1

    def place(self, state: int, letters: np.ndarray) -> None:
        """Put the children of a state into free cells."""
        low, high = int(letters[0]), int(letters[-1])
        if self.end + low + high >= len(self.check):  # so that every cell tried below exists
            more = len(self.check) + low + high
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1
        cell = max(self.free, low)
        for _ in range(TRIES):
            if cell >= self.end or (self.check[cell - low + letters] < 0).all():
                break
            cell += 1
        else:
            cell = max(self.end, low)
        base = cell - low
        self.base[state] = base
        self.check[base + letters] = state
        self.end = max(self.end, base + high + 1)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def shard_nodes(paths: list[str], chars: list[list[int]], n: np.ndarray, conv: np.ndarray, ends: list[str]) -> dict[str, list]:
    """All nodes of sorted distinct paths, in columns; the upper ones, which other shards may
    share, with their place on the first and last path and without what lies in upper nodes."""
    names = [[p[i : i + NAME] for i in range(0, len(p), NAME)] for p in paths]
    long = np.array([len(x) for x in names])
    offset = np.concatenate([[0], np.cumsum(long)[:-1]])
    _, letters = np.unique(np.array([x for row in names for x in row] or [""]), return_inverse=True)
    letters = letters + 1
    sizes = np.array([x for row in chars for x in row] or [0], np.int64)

    trie = DoubleArray(2 * (len(letters) + 2))
    state = np.zeros(len(paths), np.int64)
    levels = [(np.zeros(1, np.int64), np.array([n.sum()]), np.array([conv.min()]), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    last_state = [[0], [0]]
    for depth in range(long.max()):
        rows = np.flatnonzero(long > depth)
        letter, parent = letters[offset[rows] + depth], state[rows]
        runs = starts_of(parent, letter)
        heads = starts_of(parent[runs])
        for a, b in zip(heads, [*heads[1:], len(runs)], strict=True):
            trie.place(int(parent[runs[a]]), letter[runs[a:b]])
        state[rows] = trie.base[parent] + letter
        at = state[rows][runs]
        levels.append((at, np.add.reduceat(n[rows], runs), np.minimum.reduceat(conv[rows], runs), sizes[offset[rows][runs] + depth], rows[runs]))
        for path, row in zip(last_state, (0, len(paths) - 1), strict=True):
            if long[row] > depth:
                path.append(int(state[row]))

    # The walk: all states by level, each found again through CHECK of its cell.
    at, members, low, size, _ = (np.concatenate(x) for x in zip(*levels, strict=True))
    depth = np.repeat(np.arange(len(levels)), [len(x[0]) for x in levels])
    place = np.full(len(trie.check), -1)
    place[at] = np.arange(len(at))
    up = place[trie.check[at]]
    upper = np.zeros(len(at), bool)
    keys: dict[int, tuple[str, list[str]]] = {}
    for path, row in zip(last_state, (0, len(paths) - 1), strict=True):
        digest, chain = hashlib.md5(), []
        for d, s in enumerate(path):
            if d:
                digest.update(names[row][d - 1].encode())
            chain.append(digest.hexdigest())
            upper[place[s]] = True
            keys[int(place[s])] = (chain[-1], list(chain))
    children = np.bincount(up[1:][~upper[1:]], minlength=len(at))
    leaves, saved = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    bounds = np.cumsum([0] + [len(x[0]) for x in levels])
    for a, b in list(zip(bounds[:-1], bounds[1:], strict=True))[:0:-1]:
        own = a + np.flatnonzero(~upper[a:b])
        leaves[own] += children[own] == 0
        saved[own] += (members[own] - 1) * size[own]
        np.add.at(leaves, up[own], leaves[own])
        np.add.at(saved, up[own], saved[own])
    end = np.full(len(at), -1)
    end[place[state]] = np.arange(len(paths))
    is_upper = upper.tolist()
    return {
        "conv_id": low, "depth": depth,
        "parent_conv_id": [None if is_upper[p] or u or not d else int(low[p]) for p, u, d in zip(up.tolist(), is_upper, depth.tolist(), strict=True)],
        "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": [ends[e] if e >= 0 else NO_ENDS for e in end.tolist()],
        "chars": size,
        "place": [x if u else None for x, u in enumerate(is_upper)],
        "up": [p if is_upper[p] and not u else None for p, u in zip(up.tolist(), is_upper, strict=True)],
        "key": [keys[x][0] if u else None for x, u in enumerate(is_upper)],
        "chain": [keys[x][1] if u else None for x, u in enumerate(is_upper)],
    }


NODE = {
    "conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long",
    "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string", "chars": "long", "place": "long",
    "up": "long", "key": "string", "chain": "array<string>", "shard": "long",
}
ARROW = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def trie_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted paths of a partition, shard by shard."""
    task = TaskContext.get()
    shard = (task.partitionId() if task else 0) << 32
    rows: list[tuple] = []
    turns = 0

    def nodes() -> pa.RecordBatch:
        paths, chars, n, conv, ends = (list(x) for x in zip(*rows, strict=True))
        found = shard_nodes(paths, chars, np.array(n, np.int64), np.array(conv, np.int64), ends)
        found["shard"] = np.full(len(found["conv_id"]), shard)
        return pa.RecordBatch.from_arrays([pa.array(found[c], ARROW[k]) for c, k in NODE.items()], list(NODE))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            turns += len(row[1])
            if len(rows) >= SHARD_PATHS or turns >= SHARD_TURNS:
                yield nodes()
                shard, rows, turns = shard + 1, [], 0
    if rows:
        yield nodes()


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """Per node of the trie: its smallest conv_id, depth, parent and aggregates.

    ``turns`` has one row a conversation: conv_id, turns (name, chars). conv_id and depth name a
    node. An empty table has no node, not even the root. A conversation without turns is a
    member, and an end, of the root alone.
    """
    parts = shuffle_partitions(turns.sparkSession)
    path = F.array_join(F.transform("turns", lambda t: t["name"]), "")
    members = cut_lineage(
        turns.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
        .withColumn("seq", F.md5("path"))
    )
    distinct = members.groupBy("seq").agg(F.first("path").alias("path"), F.first("chars").alias("chars"))
    paths = cut_lineage(distinct.join(hashed_ends(members), "seq").select("path", "chars", "n", "conv_id", "ends"))
    sorted_paths = paths.repartitionByRange(parts, "path").sortWithinPartitions("path")
    rows = cut_lineage(sorted_paths.mapInArrow(trie_shards, ", ".join(f"{c} {k}" for c, k in NODE.items())))

    # Upper nodes: one row for each shard they lie in, at most two for each level of a shard.
    upper = rows.filter("key IS NOT NULL")
    merged = upper.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        # At most one shard holds the path that ends here.
        F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends"),
        F.max("chars").alias("chars"), F.first("chain").alias("chain"),
    )
    above = F.when(F.col("depth") > 0, F.element_at("chain", F.col("depth").cast("int")))
    merged = cut_lineage(merged.withColumn("above", above))
    kids = merged.filter("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("kids", F.lit(0)))
    own = merged.select(
        F.explode("chain").alias("key"),
        (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)).alias("saved"),
    )
    sums = own.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = merged.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    known = cut_lineage(
        merged.join(sums, "key").join(parents, "above", "left")
        .withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).select("key", *OUT)
    )
    # Nodes right below an upper one learn its smallest conversation, found in all shards.
    tops = upper.select("shard", F.col("place").alias("up"), "key")
    tops = tops.join(known.select("key", F.col("conv_id").alias("top_conv")), "key").drop("key")
    lower = rows.filter("key IS NULL")
    below = lower.filter("up IS NOT NULL").join(tops, ["shard", "up"]).withColumn("parent_conv_id", F.col("top_conv"))
    return known.select(*OUT).unionAll(lower.filter("up IS NULL").select(*OUT)).unionAll(below.select(*OUT))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are: one row a node."""
    return prefix_nodes(conversation_turns(conversations))


def shared_conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with shared heads: one row a node.

    Null roles and texts count as empty; rows without conv_id are left out; repeated rows are
    turns of their own; other columns are ignored; an empty table gives no row.
    """
    return prefix_nodes(shared_heads(conversation_turns(conversations)))
