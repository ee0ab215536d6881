"""Sharding: best-fit-decreasing packing of indivisible groups into fixed-capacity shards.

A group is all rows with the same text. Groups of equal size form a run, ranked by distributed
prefix sums. The packing goes through the runs from the largest size down and puts as many
groups of a run as fit into the tightest shard, which is what it would do with one group after
the other. There are at most sqrt(2 * bytes) sizes, some millions in 100 TB, however many groups.
Groups meet their shard by size and rank.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import prefix_sums
from fileledger.session import cut_lineage


class CapacityTree:
    """Balanced search tree (a treap) of (remaining capacity, bin), for tightest-fit queries."""

    def __init__(self) -> None:
        self.root = None
        self.state = 1

    def _priority(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % 2**64
        return self.state >> 20

    def _split(self, node, key):
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        k, p, left, right = node
        if k < key:
            low, high = self._split(right, key)
            return (k, p, left, low), high
        low, high = self._split(left, key)
        return low, (k, p, high, right)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], self._merge(a[3], b))
        return (b[0], b[1], self._merge(a, b[2]), b[3])

    def add(self, capacity: int, bin_no: int) -> None:
        low, high = self._split(self.root, (capacity, bin_no))
        self.root = self._merge(self._merge(low, ((capacity, bin_no), self._priority(), None, None)), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least capacity that holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._merge(low, rest)
        return node[0]


def best_fit_decreasing(sizes: Iterable[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin per item of a list in decreasing order; None once more than ``most`` bins are needed."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        if size > capacity:
            return None
        found = tree.take_tightest(size)
        if found is None:
            if most is not None and bins >= most:
                return None
            found, bins = (capacity, bins), bins + 1
        tree.add(found[0] - size, found[1])
        out.append(found[1])
    return out


def best_fit_runs(runs: Iterable[tuple[int, int]], capacity: int, most: int) -> list[tuple[int, int, int, int]] | None:
    """The same for runs (size, count) in decreasing order: (size, first rank, count, bin) of what goes
    together. The tightest bin that took one item stays the tightest for the next of its size."""
    tree, bins, out = CapacityTree(), 0, []
    for size, count in runs:
        if size > capacity:
            return None
        rank = 0
        while rank < count:
            found = tree.take_tightest(size)
            if found is None:
                if bins >= most:
                    return None
                found, bins = (capacity, bins), bins + 1
            n = min(count - rank, found[0] // size)
            tree.add(found[0] - n * size, found[1])
            out.append((size, rank, n, found[1]))
            rank += n
    return out


def pack_into(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing at the least capacity found that needs no more than ``shards`` bins."""
    low = max([-(-sum(s * n for s, n in runs) // shards), *[s for s, _ in runs[:1]]])
    high = max(low, 2 * low)
    best = best_fit_runs(runs, low, shards)
    if best is not None:
        return best
    while (best := best_fit_runs(runs, high, shards)) is None:
        high *= 2
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        got = best_fit_runs(runs, middle, shards)
        low, high, best = (low, middle, got) if got is not None else (middle, high, best)
    return best


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: the bytes of the shards are near equal, rows of equal text stay
    together. Size is the UTF-8 length plus 1. A null text counts as the empty text (size 1,
    crc 0, one group with it). A group above an even share fills a shard by itself.
    Slots number the rows of a shard without a gap. Repeated rows get slots of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("_group"),
    )
    sized = cut_lineage(sized)
    groups = cut_lineage(sized.groupBy("_group").agg(F.sum("size").alias("_bytes")))
    counted = groups.groupBy("_bytes").agg(F.count("*").alias("n")).collect()  # one row a size, see above
    moves = pack_into(sorted(((r["_bytes"], r["n"]) for r in counted), reverse=True), shards) if counted else []
    runs = spark.createDataFrame(moves, "_size long, _first long, _n long, shard int")
    ranked = prefix_sums(groups, ["_bytes"], ["_group"], F.lit(1), "_rank")
    inside = (F.col("_bytes") == F.col("_size")) & F.col("_rank").between(F.col("_first"), F.col("_first") + F.col("_n") - 1)
    # Written, so that the join with the rows reads its exchange directly and a hot group can be split.
    dealt = cut_lineage(ranked.join(runs, inside).select("_group", "shard"))
    placed = cut_lineage(sized.join(dealt, "_group"))
    slots = prefix_sums(placed, ["shard"], ["_group", "doc_id"], F.lit(1), "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
