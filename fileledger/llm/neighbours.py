"""Embedding near-dedup by NN-descent (Dong, Charikar and Li 2011).

The graph of each vector's nearest vectors starts from a forest of random projections:
vectors are range-sorted by the signs of random projections and meet their successors.
Then neighbours of neighbours are joined: a vector's neighbours, both ways, come together in
one place and are compared with each other, and lists keep the best. Two neighbours that have
met before do not meet again: a pair needs one entry that is new since the last round. Rounds
end when hardly an entry is new; the audit decides whether that was enough.

A list that is full of near pairs is saturated: there may be more. Such lists are enlarged,
first to twice the length with more rounds, then, where they are full again, to the whole
component of near pairs, in which the vector is compared with all others, block by block, and
counted, never listed. As the lists of such components hold only their own vectors, the
components are first joined: a second graph keeps the nearest vectors of other components,
and near pairs found there join components until no new one appears.

Candidates are ranked by vectors rounded to 8 bits; pairs and counts of the result are
decided by cosines in double precision. The recall of the result is audited: vectors of
different components, and enough vectors without a link to bear out the limit, are compared
with all vectors. Where it falls short another forest follows, and after the third an error.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileledger.llm.common import components, shuffle_partitions
from fileledger.session import cut_lineage

TREES = 14
SIGNS = 24
SUCCESSORS = 3
LIST = 6
#: Share of new list entries at which rounds end; the audit tells whether that was too early.
FEW_NEW = 0.01
#: Cosine by which rounded vectors may fall short of the exact one.
ROUNDING = 0.02
#: Neighbours that meet in one task; a hub's others meet in groups of the same size.
MEETING = 48
BLOCK = 1024
#: Components of which the audit compares one vector with all.
AUDITED = 256
#: Vectors without a link that the audit compares in one pass, and at most; beyond, it says so.
PORTION = 4096
MOST_ASKED = 65_536
LEAST_RECALL = 0.97

log = logging.getLogger(__name__)


def usable() -> Column:
    """Whether a row can link: label, id and vector not null, finite components, not all of them 0."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    filled = F.exists("embedding", lambda x: x != 0)
    given = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    return F.coalesce(given & ~bad & filled, F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all of the same dimension."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of extreme values stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rounded(nodes: DataFrame) -> DataFrame:
    """space, node, and the unit vector in 8-bit steps of its largest component."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                u = _units(pa.array([x.as_py()]))[0]
                out.append(np.round(u * (127 / np.abs(u).max())).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["space", "node", "v"])

    return nodes.select("space", "node", "embedding").mapInArrow(shrink, "space string, node long, v binary")


def _small(values: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(values), np.int8).reshape(len(values), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(vectors: DataFrame, seed: int) -> DataFrame:
    """(a, b, sim) of rows next to each other in the sorted orders of random sign keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array([len(v.as_py()) for v in batch.column(2)])
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                if int(d) not in planes:
                    planes[int(d)] = np.random.default_rng([seed, int(d)]).normal(size=(int(d), TREES * SIGNS)).astype(np.float32)
                bits = (_small(part.column(2).to_pylist()) @ planes[int(d)] > 0).reshape(len(part), TREES, SIGNS)
                key = (bits * (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))).sum(2)
                at = pa.array(np.repeat(np.arange(len(part)), TREES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(part))), pa.array(key.ravel()), *[c.take(at) for c in part.columns]],
                    ["tree", "key", "space", "node", "v"],
                )

    def successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in (batch.column(0), batch.column(2), batch.column(3), batch.column(4))], strict=True))
            rows, first = (tail + rows, len(tail)) if tail else (rows, 0)
            tail = rows[-SUCCESSORS:]
            i, j = [], []
            for n in range(first, len(rows)):
                for m in range(max(0, n - SUCCESSORS), n):
                    if rows[m][:2] == rows[n][:2] and rows[m][2] != rows[n][2]:
                        i.append(m), j.append(n)
            if i:
                spaces = np.array([rows[x][1] for x in i])
                for space in np.unique(spaces):
                    own = np.flatnonzero(spaces == space)
                    p, q = [i[x] for x in own], [j[x] for x in own]
                    sim = (_small([rows[x][3] for x in p]) * _small([rows[x][3] for x in q])).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows[x][2] for x in p]), pa.array([rows[x][2] for x in q]), pa.array(sim.astype(np.float32))], ["a", "b", "sim"]
                    )

    shape = "tree int, key long, space string, node long, v binary"
    keyed = vectors.select("space", "node", "v").mapInArrow(keys, shape)
    order = ["tree", "space", "key", "node"]
    ranged = keyed.repartitionByRange(shuffle_partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(successors, "a long, b long, sim float")


def best_lists(pairs: DataFrame, length: int, longer: DataFrame | None = None) -> DataFrame:
    """The ``length`` best neighbours of each node, of nodes in ``longer`` twice as many: node, near, sim, place, fresh.

    Entries are fresh unless a pair with a column ``old`` says otherwise.
    """
    pairs = pairs if "old" in pairs.columns else pairs.withColumn("old", F.lit(False))
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("near"), "sim", "old").unionAll(pairs.select("b", "a", "sim", "old"))
    each = both.groupBy("node", "near").agg(F.max("sim").alias("sim"), (~F.max("old")).alias("fresh"))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "near")))
    if longer is None:
        return ranked.filter(F.col("place") <= length)
    ranked = ranked.filter(F.col("place") <= 2 * length).join(longer.select("node", F.lit(True).alias("_more")), "node", "left")
    return ranked.filter((F.col("place") <= length) | F.col("_more")).drop("_more")


def meet(lists: DataFrame, vectors: DataFrame, longer: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """(a, b, sim) of neighbours of a common node that would enter the list of one of them.

    One of the two entries is fresh. Where ``vectors`` has an area, pairs of one area are left out; ``own`` has the neighbours
    inside the areas, which meet the others too.
    """
    full = lists.groupBy("node").agg(F.min("sim").alias("floor"), F.count("*").alias("entries")).withColumn("length", F.lit(LIST))
    if longer is not None:
        full = full.join(longer.select("node", F.lit(2 * LIST).alias("_more")), "node", "left").withColumn("length", F.coalesce("_more", "length"))
    full = full.filter("entries >= length").select("node", "floor")
    near = lists.select("node", "near", "fresh")
    near = near if own is None else near.unionAll(own.select("node", "near", F.lit(False)))
    ways = near.select(F.col("node").alias("centre"), F.col("near").alias("node"), "fresh").unionAll(near.select(F.col("near").alias("centre"), "node", "fresh"))
    ways = ways.groupBy("centre", "node").agg(F.max("fresh").alias("fresh"))
    # The neighbours of a hub meet in random groups of about MEETING.
    sizes = ways.groupBy("centre").agg(F.ceil(F.count("*") / MEETING).alias("groups"), F.max("fresh").alias("_any"))
    sizes = sizes.filter("_any").drop("_any")
    ways = ways.join(sizes, "centre").withColumn("part", F.pmod(F.xxhash64("node", "centre"), F.col("groups")))
    area = F.col("area") if "area" in vectors.columns else F.col("node")
    rows = ways.join(vectors.select("node", area.alias("area"), "v"), "node").join(full, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)).cast("float"))
    rows = rows.select("centre", "part", "node", "area", "floor", "fresh", "v").repartition("centre", "part").sortWithinPartitions("centre", "part", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            done, rest = cut_last(table)
            if done.num_rows:
                yield from found_in(done)
        if rest is not None and rest.num_rows:
            yield from found_in(rest)

    def cut_last(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        """Whole groups, and the last one, which may go on in the next batch."""
        c, p = table["centre"].to_numpy(), table["part"].to_numpy()
        start = np.flatnonzero((c != c[-1]) | (p != p[-1]))
        cut = int(start[-1]) + 1 if len(start) else 0
        return table.slice(0, cut), table.slice(cut)

    def found_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c, p, node, area, floor, fresh = (table[x].to_numpy() for x in ("centre", "part", "node", "area", "floor", "fresh"))
        edge = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])])
        values = table["v"].to_pylist()
        a, b, s = [], [], []
        for start, end in zip(edge, [*edge[1:], len(c)], strict=True):
            if end - start < 2:
                continue
            x = _small(values[start:end])
            sim = x @ x.T
            low, at, new = floor[start:end], area[start:end], fresh[start:end]
            wanted = (sim > np.minimum(low[:, None], low[None, :])) & (at[:, None] != at[None, :]) & (new[:, None] | new[None, :])
            i, j = np.nonzero(np.triu(wanted, 1))
            a.append(node[start + i]), b.append(node[start + j]), s.append(sim[i, j])
        if a:
            pairs = pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "sim": np.concatenate(s).astype(np.float32)})
            yield from pairs.group_by(["a", "b"]).aggregate([("sim", "max")]).rename_columns(["a", "b", "sim"]).to_batches()

    return rows.mapInArrow(compare, "a long, b long, sim float")


def descend(lists: DataFrame, vectors: DataFrame, longer: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Rounds of meeting until at most FEW_NEW of all entries are new."""
    while True:
        old = lists.select(F.col("node").alias("a"), F.col("near").alias("b"), "sim", F.lit(True).alias("old"))
        met = meet(lists, vectors, longer, own).withColumn("old", F.lit(False))
        lists = cut_lineage(best_lists(old.unionAll(met), LIST, longer))
        size = lists.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        if size["fresh"] <= FEW_NEW * size["n"]:
            return lists


def saturated(lists: DataFrame, longer: DataFrame, near: float) -> DataFrame:
    """The nodes whose list, of its own length, is full of near pairs."""
    ends = lists.filter(F.col("place").isin(LIST, 2 * LIST) & (F.col("sim") >= near))
    ends = ends.join(longer.select("node", F.lit(2 * LIST).alias("_more")), "node", "left")
    return ends.filter(F.col("place") == F.coalesce("_more", F.lit(LIST))).select("node").distinct()


def joined_areas(pairs: DataFrame, lists: DataFrame, full: DataFrame, vectors: DataFrame, near: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The components (node, area) of near pairs with saturated nodes, and the near pairs with those found between them."""
    trees = None
    while True:
        areas = cut_lineage(components(pairs).withColumnsRenamed({"component": "area"}))
        hot = cut_lineage(areas.join(areas.join(full, "node").select("area").distinct(), "area").select("node", "area"))
        if hot.select("area").distinct().count() < 2:
            return hot, pairs
        placed = cut_lineage(vectors.join(hot, "node"))
        if trees is None:
            trees = cut_lineage(forest(placed, seed))
        one, two = hot.withColumnsRenamed({"node": "a", "area": "_a"}), hot.withColumnsRenamed({"node": "b", "area": "_b"})
        start = trees.join(one, "a").join(two, "b").filter("_a <> _b").select("a", "b", "sim")
        own = lists.join(hot.select("node"), "node").join(hot.select(F.col("node").alias("near")), "near").select("node", "near")
        cross = descend(cut_lineage(best_lists(start, LIST)), placed, None, own)
        cross = cross.filter(F.col("sim") >= near).select(F.col("node").alias("a"), F.col("near").alias("b"), "sim")
        if cross.isEmpty():
            return hot, pairs
        pairs = cut_lineage(pairs.unionAll(cross))


def exact_links(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision is at least ``least``."""
    one = nodes.select(F.col("node").alias("a"), F.col("embedding").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("embedding").alias("y"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [float(cosines(x.as_py(), y.as_py())) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(decide, "a long, b long")


def cosines(x, y) -> np.ndarray:
    return (_units(pa.array([x])) * _units(pa.array([y]))).sum(1)[0]


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's connected component in a symmetric matrix."""
    root = np.arange(len(linked))
    open_ = linked.any(1)
    for first in np.flatnonzero(open_):
        at = np.array([first]) if open_[first] else np.array([], np.int64)
        while len(at):
            open_[at] = False
            root[at] = first
            at = np.flatnonzero(linked[at].any(0) & open_)
    return root


def swept_links(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, links, root) of all links with a saturated end inside each area, in blocks.

    ``members`` has node, area and full. A pair of blocks gives one row per node: the rows linked
    to it there and a node it is connected with there.
    """
    sizes = members.groupBy("area").agg(
        F.ceil(F.count_if("full") / BLOCK).cast("int").alias("head"), F.ceil(F.count_if(~F.col("full")) / BLOCK).cast("int").alias("tail")
    )
    rows = members.join(sizes, "area").join(nodes.select("node", "copies", "embedding"), "node")
    # Saturated nodes fill the first blocks and meet all; the others meet only those.
    place = F.when(F.col("full"), F.pmod(F.xxhash64("node"), F.col("head"))).otherwise(F.col("head") + F.pmod(F.xxhash64("node"), F.greatest("tail", F.lit(1))))
    rows = rows.withColumn("block", place.cast("int"))
    met = F.when(F.col("full"), F.col("head") + F.col("tail")).otherwise(F.col("head"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    rows = rows.select("area", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "embedding")

    def count(table: pa.Table) -> pa.Table:
        block, node, copies = (table[c].to_numpy() for c in ("block", "node", "copies"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        u = _units(table["embedding"].combine_chunks())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = u[left] @ u[right].T >= least
        linked = np.zeros((len(u), len(u)), bool)
        linked[np.ix_(left, right)] = near
        linked[np.ix_(right, left)] = near.T
        np.fill_diagonal(linked, False)
        return pa.table({"node": node, "links": linked @ copies, "root": node[_roots(linked)]})

    return rows.groupBy("area", "i", "j").applyInArrow(count, "node long, links long, root long")


def true_links(asked: list, nodes: DataFrame, least: float) -> dict[int, int]:
    """node -> rows linked to it, of the rows (space, node, copies, embedding) against all vectors."""
    by_space: dict[str, list] = {}
    for r in asked:
        by_space.setdefault(r["space"], []).append((r["node"], list(r["embedding"])))
    shared = nodes.sparkSession.sparkContext.broadcast(by_space)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = {name: _units(pa.array([v for _, v in own])) for name, own in shared.value.items()}
        found = {name: np.zeros(len(u)) for name, u in units.items()}
        for batch in batches:
            space = np.array(batch.column(0).to_pylist())
            for name, u in units.items():
                own = batch.filter(pa.array(space == name))
                for at in range(0, len(own), BLOCK):
                    part = own.slice(at, BLOCK)
                    hit = u @ _units(part.column(2)).T >= least
                    found[name] += hit.astype(np.float32) @ part.column(1).to_numpy().astype(np.float64)
        for name, own in shared.value.items():
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array(found[name].astype(np.int64))], ["node", "links"])

    parts = nodes.select("space", "copies", "embedding").mapInArrow(compare, "node long, links long")
    copies = {r["node"]: r["copies"] for r in asked}
    # Each vector has met itself.
    out = {r["node"]: r["links"] - copies[r["node"]] for r in parts.groupBy("node").agg(F.sum("links").alias("links")).collect()}
    shared.unpersist()
    return out


def audit(counted: DataFrame, nodes: DataFrame, least: float) -> float:
    """Recall of ``counted`` (node, links, group), by components and vectors instead of links.

    One vector of each of AUDITED components must have all its links. Of the vectors without a
    link so many are asked, by hash, that a loss beyond LEAST_RECALL would show with 95 %, all
    of them where few or no components were found. Each that has a link counts as a component
    that was missed.
    """
    columns = ["space", "node", "copies", "embedding"]
    groups = counted.groupBy("group").agg(F.min_by("node", F.xxhash64("node", F.lit("audit"))).alias("node"))
    groups = cut_lineage(groups)
    found = groups.count()
    shown = groups.orderBy(F.xxhash64("group", F.lit("audit"))).limit(AUDITED).select("node").join(counted.select("node", "links"), "node")
    shown = shown.join(nodes.select(columns), "node").collect()
    true = true_links(shown, nodes, least) if shown else {}
    whole = sum(r["links"] >= true[r["node"]] for r in shown) / len(shown) if shown else 1.0

    alone = cut_lineage(nodes.select(columns).join(counted.select("node"), "node", "left_anti"))
    rest = alone.count()
    needed = min(rest, math.ceil(3 * rest / ((1 - LEAST_RECALL) * found))) if found else rest
    portions = max(1, math.ceil(rest / PORTION))
    asked = missed = 0
    for portion in range(portions):
        if asked >= min(needed, MOST_ASKED):
            break
        some = alone.filter(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(portions)) == portion).select(columns).collect()
        asked += len(some)
        missed += sum(n > 0 for n in true_links(some, nodes, least).values()) if some else 0
    if asked < needed:
        log.warning("op5 audit: %d of the %d vectors without a link that would bear out the recall were asked", asked, needed)
    lost = missed / asked * rest if asked else 0.0
    recall = whole * (found / (found + lost) if lost else 1.0)
    log.info("op5 audit: recall %.4f; %d components, %.4f of %d whole; %d of %d vectors without a link have one", recall, found, whole, len(shown), missed, asked)
    return recall


def link_vectors(vectors: DataFrame, least: float = 0.98) -> tuple[DataFrame, DataFrame, float]:
    """(nodes, (node, links, group), audited recall). A node is all rows of one label with equal vectors."""
    rows = vectors.filter(usable()).select("label", "embedding")
    space = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    rows = rows.withColumn("space", space).withColumn("node", F.xxhash64("label", "embedding"))
    nodes = cut_lineage(rows.groupBy("space", "node").agg(F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    small = cut_lineage(rounded(nodes))
    near = least - ROUNDING
    pairs = None
    for attempt in range(3):
        trees = forest(small, 100 + attempt)
        start = trees if pairs is None else trees.unionAll(pairs)
        lists = descend(cut_lineage(best_lists(start, LIST)), small)
        # Saturated: the last place of a full list still is a near pair.
        more = cut_lineage(saturated(lists, lists.select("node").limit(0), near))
        if not more.isEmpty():
            # Longer lists take in more of what has met before, so all entries meet once more.
            lists = descend(lists.withColumn("fresh", F.lit(True)), small, more)
        full = cut_lineage(saturated(lists, more, near))
        pairs = lists.filter(F.col("sim") >= near).select(F.col("node").alias("a"), F.col("near").alias("b"), "sim")
        areas, pairs = joined_areas(pairs, lists, full, small, near, 200 + attempt)
        candidates = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        links = cut_lineage(exact_links(candidates, nodes, least))
        members = areas.join(full.withColumn("full", F.lit(True)), "node", "left").withColumn("full", F.coalesce("full", F.lit(False)))
        swept = cut_lineage(swept_links(members, nodes, least))
        joins = links.unionAll(swept.filter("node <> root").select("node", "root"))
        groups = cut_lineage(components(joins).withColumnsRenamed({"component": "group"}))
        # Links with a saturated end are counted in the sweep, the others from the lists.
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(links.select("b", "a"))
        ends = ends.join(full, "node", "left_anti").join(full.withColumnsRenamed({"node": "near"}), "near", "left_anti")
        listed = ends.join(nodes.select(F.col("node").alias("near"), "copies"), "near").select("node", F.col("copies").alias("links"))
        counted = listed.unionAll(swept.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
        counted = cut_lineage(counted.join(groups, "node"))
        recall = audit(counted, nodes, least)
        if recall >= LEAST_RECALL:
            break
    return nodes, counted, recall


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows link within a label with a cosine of at least ``least``. Equal vectors of one label
    are one node, whose rows link with each other. Rows whose label, id or vector is null, and
    vectors that are all 0, hold null or a component that is not finite, link with nothing;
    vectors of different dimensions do not meet. A row without an id has no component id and
    is kept. An empty table gives an empty result; other columns are ignored. An audited recall
    below LEAST_RECALL is an error; link_vectors hands the result and its recall out.
    """
    nodes, counted, recall = link_vectors(vectors, least)
    if recall < LEAST_RECALL:
        raise RuntimeError(f"audited recall {recall:.4f} is below {LEAST_RECALL}")
    known = vectors.filter(usable()).select("vec_id", F.xxhash64("label", "embedding").alias("node"))
    rest = vectors.filter(~usable()).select("vec_id")
    placed = known.join(nodes.select("node", "copies"), "node").join(counted, "node", "left")
    placed = placed.withColumn("group", F.coalesce("group", "node")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    placed = cut_lineage(placed.select("vec_id", "n_links", "group"))
    lowest = placed.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    linked = placed.join(lowest, "group").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionAll(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

