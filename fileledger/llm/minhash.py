"""Near-duplicate documents with HyperMinHash registers (Yu and Weber 2017).

A document's shingle hashes fall into REGISTERS buckets by their leading bits. A register
stores, for the least hash of its bucket, the count of leading zeros and the mantissa bits
behind the first one. Empty registers are filled from the next filled one of a fixed random
order, so that two registers agree with the probability of the Jaccard similarity at every
set size. Bands of registers give candidates; the share of equal registers, corrected for
chance agreement, estimates the similarity; what may reach the threshold is decided on the
full sets.

Documents with equal sets are one node. In a band bucket every node first meets the least node
and the one that shares most buckets with others, as the original of many copies does, so that
a large group of near copies costs two pairs a node. Whatever
the verified links leave apart is then compared in full: small buckets by a join, large ones
block by block inside tasks, which get the full sets along with the registers, decide the pairs
whose estimate passes, and hand on only links that join two groups. Nodes of a bucket's largest
group meet only those outside it, so that one outsider costs a large group one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import components, hand_back, in_few_tasks
from fileledger.session import cut_lineage

INDEX_BITS = 7
REGISTERS = 1 << INDEX_BITS
MANTISSA_BITS = 10
BANDS, ROWS = 25, 5
#: Standard errors below the threshold at which an estimate still passes.
ERRORS = 4.0
#: Sets below this size are always decided on the full sets.
SMALL_SET = 16
#: Buckets up to this size are compared by a join, others in blocks of BLOCK nodes.
SMALL_BUCKET = 32
BLOCK = 512
#: Sets that a task compares with one set at a time.
COMPARED = 64
#: Node ids to broadcast at most; more are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words."""

    def __init__(self, width: int) -> None:
        import xxhash

        self.width, self.hash = width, xxhash.xxh3_64_intdigest
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        # bytes.lower() and bytes.split() know A-Z and ASCII white space only, as wanted.
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        ids = list(map(known.get, words))
        if None in ids:
            known.update((w, self.hash(w)) for w, i in zip(words, ids, strict=True) if i is None)
            ids = list(map(known.get, words))
        w = np.array(ids, np.uint64)
        width = min(self.width, len(w))
        h = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            h = h * _PRIME + w[k : len(w) - width + 1 + k]
        return np.unique(mix(h + np.uint64(width)))


def fill_order() -> np.ndarray:
    """For each register a random order of all registers, itself first."""
    rng = np.random.default_rng(11)
    order = np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])
    for i, row in enumerate(order):
        at = int(np.flatnonzero(row == i)[0])
        row[0], row[at] = row[at], row[0]
    return order


def registers(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The REGISTERS compressed registers of a sorted, non-empty set."""
    rest_bits = 64 - INDEX_BITS
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(rest_bits)
    at = np.searchsorted(hashes, bounds)
    filled = at < len(hashes)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    filled &= (least >> np.uint64(rest_bits)) == np.arange(REGISTERS, dtype=np.uint64)
    rest = least & np.uint64((1 << rest_bits) - 1)
    # frexp of an integer below 2**57 gives its bit length, but for rounding at the top: keep 53 bits.
    top = rest >> np.uint64(rest_bits - 53)
    length = np.frexp(top.astype(np.float64))[1].astype(np.int64)
    zeros = 53 - length
    mantissa = np.where(
        length > MANTISSA_BITS, (top >> np.maximum(length - 1 - MANTISSA_BITS, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1), top
    ).astype(np.int64)
    packed = ((zeros << MANTISSA_BITS) | mantissa).astype(np.uint16)
    if not filled.all():
        packed = packed[order[np.arange(REGISTERS), filled[order].argmax(1)]]
    return packed


def chance_agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that two registers agree though their least hashes differ, by the set sizes.

    Both minima must lie in the same cell: sum over the leading-zero levels of the integral of
    the product of their densities times the cell width.
    """
    a, b = np.maximum(1.0, a / REGISTERS), np.maximum(1.0, b / REGISTERS)
    level = np.arange(54, dtype=float)
    high, low = 2.0**-level, 2.0 ** -(level + 1)
    power = (a + b - 1)[:, None]
    mass = ((1 - low) ** power - (1 - high) ** power) / power
    return np.minimum(0.5, (a * b) * (mass * low * 2.0**-MANTISSA_BITS).sum(1))


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance agreement."""
    e = chance_agreement(a, b)
    return (equal - e) / (1 - e)


def may_link(equal: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a pair can reach the threshold: by its sizes, and by its estimate unless a set is small.

    Registers that were filled from others tell nothing new: the error is that of those with a hash.
    """
    small, large = np.minimum(a, b), np.maximum(a, b)
    own = REGISTERS * -np.expm1(-small / REGISTERS)
    least = threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / own)
    return (small >= threshold * large - 1e-9) & ((small < SMALL_SET) | (estimate(equal, a, b) >= least))


def set_id(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a set's digest; the first names its node."""
    import xxhash

    digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (digest & (2**64 - 1)) - 2**63, (digest >> 64) - 2**63


def row_keys() -> list[Column]:
    """128 bits that tell rows of different id or text apart; null ids count too."""
    text = F.col("text")
    return [F.xxhash64("doc_id", text).alias("row1"), F.xxhash64(F.lit("row"), text, "doc_id").alias("row2")]


def sketch_documents(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, row1, row2, n_shingles, node and node2 (id of the set, null for an empty one), registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, order = Shingles(width), fill_order()
        for batch in batches:
            n, node, node2, regs = [], [], [], []
            for value in batch.column(3):
                h = shingles(value.as_py() or "")
                n.append(len(h))
                if len(h):
                    first, second = set_id(h)
                    node.append(first), node2.append(second)
                    regs.append(registers(h, order).tobytes())
                else:
                    node.append(None), node2.append(None), regs.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(node2, pa.int64()), pa.array(regs, pa.binary())],
                ["doc_id", "row1", "row2", "n_shingles", "node", "node2", "registers"],
            )
        del shingles
        hand_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, row1 long, row2 long, n_shingles long, node long, node2 long, registers binary"
    return docs.select("doc_id", *row_keys(), "text").mapInArrow(sketch, shape)


def with_own_nodes(rows: DataFrame) -> DataFrame:
    """Give sets that share the first half of their digest by chance, but for one, the second half as node."""
    halves = rows.filter("node is not null").groupBy("node").agg(F.min("node2").alias("low"), F.max("node2").alias("high"))
    clashes = cut_lineage(halves.filter("low <> high").select("node", "low"))
    if clashes.isEmpty():
        return rows
    moved = rows.join(clashes, "node", "left")
    moved = moved.withColumn("node", F.when(F.col("low").isNotNull() & (F.col("node2") != F.col("low")), F.col("node2")).otherwise(F.col("node")))
    return cut_lineage(moved.select(*rows.columns))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def bucket_keys(matrix: np.ndarray) -> np.ndarray:
    """The bucket of each row of registers in each band."""
    cut = matrix[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * _PRIME + cut[:, :, k])
    return key.view(np.int64)


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) for each band of a node's registers."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            key = bucket_keys(_matrix(batch.column(1))).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])

    return nodes.select("node", "registers").mapInArrow(keys, "key long, node long")


def passing(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and estimate may reach the threshold."""
    one = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    two = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b, na, ra, nb, rb = batch.columns
            equal = (_matrix(ra) == _matrix(rb)).mean(1)
            keep = pa.array(may_link(equal, na.to_numpy(), nb.to_numpy(), threshold))
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    met = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "ra", "nb", "rb")
    return met.mapInArrow(check, "a long, b long")


class Owners(NamedTuple):
    """A row that has the text of each node, and whether some rows are equal in id and text."""

    rows: DataFrame
    repeated: bool


def node_texts(wanted: DataFrame, docs: DataFrame, owners: Owners) -> DataFrame:
    """(node, text) of the wanted nodes, once each, by the key of a row that has the text.

    The few keys are broadcast where they are counted to be few, so that other texts are not
    moved. Joins with a hot node can be split, as what they read is either written or scanned.
    """
    wanted = in_few_tasks(owners.rows.join(wanted, "node"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    found = docs.select(*row_keys(), "text").join(wanted, ["row1", "row2"]).select("node", "text")
    return cut_lineage(found.groupBy("node").agg(F.first("text").alias("text"))) if owners.repeated else found


def node_sets(wanted: DataFrame, docs: DataFrame, owners: Owners, width: int) -> DataFrame:
    """(node, hashes): the sorted shingle hashes of each wanted node, eight bytes each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            hashes = [shingles(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in hashes], pa.binary())], ["node", "hashes"])

    return node_texts(wanted, docs, owners).mapInArrow(sets, "node long, hashes binary")


def verified(pairs: DataFrame, docs: DataFrame, owners: Owners, width: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    texts = node_texts(ends, docs, owners)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        last: dict[int, np.ndarray] = {}

        def whole(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in last:
                if len(last) > 64:
                    last.clear()
                last[node] = shingles(text.as_py())
            return last[node]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                p, q = whole(a, x), whole(b, y)
                common = int(np.isin(p, q, assume_unique=True, kind="sort").sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
        last.clear()
        hand_back()

    first = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "x"}), "a")
    both = first.join(texts.withColumnsRenamed({"node": "b", "text": "y"}), "b").select("a", "b", "x", "y")
    # A hot node's pairs come in a row, so that its set is made once.
    return both.sortWithinPartitions("b").mapInArrow(decide, "a long, b long")


def links_between(table: pa.Table, threshold: float, percent: int) -> pa.Table:
    """Links between nodes of different groups in two blocks, i and j, of one bucket.

    A pair is decided in the first bucket it shares, on the full sets if its estimate passes.
    Groups grow as links are found, so that a pair within one is not decided again.
    """
    key, i, j = (table[c][0].as_py() for c in ("key", "i", "j"))
    block, node, group = (table[c].to_numpy() for c in ("block", "node", "group"))
    group = group.copy()
    regs = _matrix(table["registers"])
    sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in table["hashes"]]
    n = np.array([len(h) for h in sets])
    buckets = bucket_keys(regs)
    earlier = buckets[:, : int((buckets[0] == key).argmax())]
    right = np.flatnonzero(block == j)
    a, b = [], []
    for x in np.flatnonzero(block == i):
        y = right[(group[right] != group[x]) & ((node[right] > node[x]) | (i != j))]
        y = y[~(earlier[y] == earlier[x]).any(1)]
        y = y[may_link((regs[y] == regs[x]).mean(1), np.full(len(y), n[x]), n[y], threshold)]
        for start in range(0, len(y), COMPARED):
            some = y[start : start + COMPARED]
            some = some[group[some] != group[x]]
            if not len(some):
                continue
            values = np.concatenate([sets[k] for k in some])
            at = np.minimum(np.searchsorted(sets[x], values), n[x] - 1)
            common = np.add.reduceat(sets[x][at] == values, np.cumsum(n[some]) - n[some], dtype=np.int64)
            for k in some[100 * common >= percent * (n[x] + n[some] - common)]:
                if group[k] != group[x]:
                    a.append(min(node[x], node[k])), b.append(max(node[x], node[k]))
                    group[group == group[k]] = group[x]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def apart(
    members: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, owners: Owners, width: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """What shares a bucket and lies in different groups: pairs of small buckets that may
    reach the threshold, and verified links of large ones."""
    threshold = percent / 100
    placed = members.select("key", "node").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    counts = placed.groupBy("key", "group").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "group"))
    open_keys = counts.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("groups"), largest["n"].alias("most"), largest["group"].alias("main"))
    open_keys = open_keys.filter("groups > 1").select("key", "size", "most", "main")
    placed = cut_lineage(placed.join(open_keys, "key"))
    small = placed.filter(F.col("size") <= SMALL_BUCKET)
    other = small.select("key", F.col("node").alias("b"), F.col("group").alias("group_b"))
    pairs = small.join(other, "key").filter("node < b and group <> group_b").select(F.col("node").alias("a"), "b").distinct()
    by_join = passing(pairs, nodes, threshold)

    # Each large bucket in blocks; a task sees two blocks.
    large = placed.filter(F.col("size") > SMALL_BUCKET)
    sets = node_sets(large.select("node").distinct(), docs, owners, width)
    large = large.join(nodes.select("node", "registers").join(sets, "node"), "node")
    # Outsiders fill the first blocks and meet all; the main group meets only those.
    head, tail = F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("most") / BLOCK).cast("int")
    inside = F.col("group") == F.col("main")
    block = F.when(inside, head + F.pmod(F.xxhash64("node"), tail)).otherwise(F.pmod(F.xxhash64("node"), head))
    large = large.withColumn("block", block.cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.when(inside, head).otherwise(head + tail) - 1)).alias("other")
    large = large.select("key", "node", "group", "registers", "hashes", "block", meets)
    large = large.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "group", "registers", "hashes")
    by_block = large.groupBy("key", "i", "j").applyInArrow(lambda t: links_between(t, threshold, percent), "a long, b long")
    return by_join, by_block


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Rows link with 100 * intersection >= percent * union of their shingle sets (words in
    lower case for A-Z; with fewer words than ``width`` the whole sequence is one shingle).
    component_id is the smallest doc_id reachable, itself included; kept says that it is the
    row's own. Null texts and texts without a word have an empty set and link with nothing.
    Rows without an id take part, but give no component id; one that is linked with no id has
    none and is kept. Rows with the same id and different texts are nodes of their own. An
    empty table gives an empty result; other columns are ignored.
    """
    threshold = percent / 100
    rows = with_own_nodes(cut_lineage(sketch_documents(docs, width)))
    filled = rows.filter("node is not null")
    nodes = cut_lineage(filled.select("node", "n_shingles", "registers").dropDuplicates(["node"]))
    chosen = filled.groupBy("node").agg(F.min(F.struct("row1", "row2")).alias("row")).select("node", "row.*")
    owners = Owners(chosen, not filled.groupBy("row1", "row2").count().filter("count > 1").isEmpty())
    keys = band_keys(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).filter("n > 1")
    members = cut_lineage(keys.join(shared, "key"))
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    star = members.select(F.col("node").alias("a"), F.col("low").alias("b")).unionAll(members.join(hubs, "key").select("node", "hub"))
    star = star.filter("a <> b").distinct()
    tried = in_few_tasks(passing(star, nodes, threshold))
    links = in_few_tasks(verified(tried, docs, owners, width, percent).distinct())
    groups = components(links).withColumnsRenamed({"component": "group"})
    known = groups.select(F.col("node").alias("a"), F.col("group").alias("b"))
    rest, joining = apart(members, groups, nodes, docs, owners, width, percent)
    joining = in_few_tasks(joining.distinct())
    either = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = in_few_tasks(rest.join(either, ["a", "b"], "left_anti"))
    more = verified(rest, docs, owners, width, percent)
    groups = components(known.unionAll(joining).unionAll(more)).withColumnsRenamed({"component": "group"})
    placed = rows.select("doc_id", "n_shingles", "node").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    placed = cut_lineage(placed.drop("node"))
    # A written table, so that the join reads its exchange directly and a hot group's rows can be split.
    least = cut_lineage(placed.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")))
    out = placed.join(least, "group", "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
