"""Language-model scores from a class-based bigram model (Brown et al. 1992).

P(word | word before) = P(class | class before) * P(word | class). Exchange clustering assigns
words to classes so that the class bigrams of the training texts become likely: core words,
each at least 1/4000 of all tokens and so at most 4000, are moved one by one, to and fro, until
the likelihood no longer rises; then every other word, in one batch over all of them, moves to
the class that gains the likelihood most for the classes around it (Uszkoreit and Brants 2008
exchange words in such batches too).

Texts are read once and become blocks: token ids, numbered inside the block, and the block's
words, compressed. What else is shuffled is one row for each word of a block, never one for each
token, so no word is hot: the later steps look up numbers by position. Known words give a
discount of their counts to the unknown word, class by class; transitions are smoothed with
class shares. Sizes of classes and vocabulary are the same for all tokens of a kind, so they
enter the scores at the end and the blocks meet the word counts only once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import shuffle_partitions
from fileledger.session import cut_lineage

#: Tokens at which a block ends; one text is never cut, so a longer one makes a longer block.
BLOCK_TOKENS = 2_000_000
#: A core word is at least this share of all training tokens.
CORE_SHARE = 1 / 4000
CLASSES = 100
ROUNDS = 10
#: Pseudo-count of the class shares in each row of transitions.
SHARE_WEIGHT = 5.0
#: Taken from the count of each known word.
DISCOUNT = 0.75
#: Words that may be core words, to be broadcast at most; more are joined by shuffle.
BROADCAST_WORDS = 200_000
#: Bits of a packed count; the context's number lies in the eight above.
COUNT_BITS = 24
#: The place of a block's own row behind the rows of its words.
BEHIND = 2**31 - 1

BLOCK = "block long, n_docs long, doc_ids array<{id}>, held binary, lengths binary, ids binary, words binary, counts binary, train_docs long, train_tokens long"


def pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def packed(x: np.ndarray) -> pa.Array:
    """One value: the numbers' first bytes, then their second bytes and so on, compressed."""
    return pa.array([pack(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())], pa.binary())


def numbers(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(unpack(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def token_blocks(docs: DataFrame, held: Column) -> DataFrame:
    """Blocks of texts as numbered tokens: one row a block, written to the checkpoint folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        doc_ids, flags, tokens, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in tokens], np.int32)
            flat, out = np.concatenate(tokens), np.array(flags, bool)
            counts = np.bincount(flat[~np.repeat(out, lengths)], minlength=len(ids))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block]), pa.array([len(tokens)]), pa.ListArray.from_arrays([0, len(tokens)], pa.concat_arrays(doc_ids)),
                    packed(out), packed(lengths), packed(flat), pa.array([pack(b" ".join(ids))], pa.binary()),
                    packed(counts.astype(np.int32)), pa.array([int((~out).sum())]), pa.array([int(counts.sum())]),
                ],
                ["block", "n_docs", "doc_ids", "held", "lengths", "ids", "words", "counts", "train_docs", "train_tokens"],
            )

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            outs = batch.column(2).to_pylist()
            first = 0
            for at, text in enumerate(texts):
                found = (text.as_py() or b"").lower().split()
                tokens.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                flags.append(outs[at])
                size += len(found) + 1
                if size >= BLOCK_TOKENS:
                    doc_ids.append(batch.column(0).slice(first, at + 1 - first))
                    yield row()
                    first, block, size = at + 1, block + 1, 0
                    ids = defaultdict(count().__next__)
                    doc_ids, flags, tokens = [], [], []
            doc_ids.append(batch.column(0).slice(first))
        if tokens:
            yield row()

    rows = docs.select("doc_id", "text", held.alias("held")).mapInArrow(blocks, BLOCK.format(id=kind))
    return cut_lineage(rows)


def word_list(words: bytes) -> list[bytes]:
    return unpack(words).split()


def core_words(blocks: DataFrame, share: float, least: float) -> dict[bytes, int]:
    """Words of at least a share of all training tokens, ``least`` in number, the most frequent first.

    Such a word has the share in some block: only words of which that is true are summed up.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.flatnonzero(numbers(counts, np.int32) >= max(1.0, share * total))
                yield pa.RecordBatch.from_arrays([pa.array(word_list(words), pa.binary()).take(pa.array(at))], ["word"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = pa.array(numbers(counts, np.int32).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(word_list(words), pa.binary()), n], ["word", "n"])

    some = cut_lineage(blocks.select("words", "counts", "train_tokens").mapInArrow(frequent, "word binary").distinct())
    some = F.broadcast(some) if some.count() <= BROADCAST_WORDS else some
    rows = blocks.select("words", "counts").mapInArrow(counted, "word binary, n long").join(some, "word")
    rows = rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(least))
    core = [(bytes(r["word"]), r["n"]) for r in rows.collect()]  # at most 1 / share
    return dict(sorted(core, key=lambda x: (-x[1], x[0])))


def codes_of(words: list[bytes], core: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter((core.get(w, other) for w in words), np.int32, len(words))


def text_line(codes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Codes of the tokens of all texts in a row, with ``end`` before the first and after each."""
    line = np.full(len(ids) + len(lengths) + 1, end, codes.dtype)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths) + 1
    line[at] = codes[ids] if len(ids) else 0
    return line


def training_part(held: bytes, lengths: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    out, size, flat = numbers(held, bool), numbers(lengths, np.int32), numbers(ids, np.int32)
    return flat[~np.repeat(out, size)], size[~out]


def core_bigrams(blocks: DataFrame, core: dict[bytes, int]) -> np.ndarray:
    """Bigrams of core words, of all others as one word, and of the end of a text."""
    sent = blocks.sparkSession.sparkContext.broadcast({w: n for n, w in enumerate(core)})
    wide = len(core) + 2

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, lengths, ids, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = codes_of(word_list(words), sent.value, wide - 2)
                line = text_line(codes, *training_part(held, lengths, ids), wide - 1).astype(np.int64)
                pair, n = np.unique(line[:-1] * wide + line[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    rows = blocks.select("held", "lengths", "ids", "words").mapInArrow(pairs, "pair long, n long")
    table = np.zeros(wide * wide)
    # At most (core + 2) squared rows, whatever the corpus.
    found = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(wide, wide)


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each core word, and the bigrams of classes; the last two words keep their own.

    Every word in turn leaves its class and joins the one that makes the class bigrams most
    likely; rounds end when no word moves.
    """
    m = len(bigrams) - 2
    wide = classes + 2
    of = np.concatenate([np.arange(m) % classes, [classes, classes + 1]])
    member = np.zeros((m + 2, wide))
    member[np.arange(m + 2), of] = 1
    left, right = bigrams.T @ member, bigrams @ member
    table = member.T @ right
    each = np.arange(classes)
    for _ in range(rounds if m else 0):
        moved = False
        for w in range(m):
            before, after, own, was = left[w].copy(), right[w].copy(), bigrams[w, w], of[w]
            before[was] -= own
            after[was] -= own
            table[:, was] -= before
            table[was, :] -= after
            table[was, was] -= own
            rows, columns = table.sum(1)[:classes], table.sum(0)[:classes]
            into, out = table[:, :classes], table[:classes, :].T
            gain_in = x_log_x(into + before[:, None]) - x_log_x(into)
            gain_out = x_log_x(out + after[:, None]) - x_log_x(out)
            corner = table[each, each]
            gain = gain_in.sum(0) + gain_out.sum(0) - gain_in[each, each] - gain_out[each, each]
            gain += x_log_x(corner + before[:classes] + after[:classes] + own) - x_log_x(corner)
            n_out, n_in = after.sum() + own, before.sum() + own
            gain -= x_log_x(rows + n_out) - x_log_x(rows) + x_log_x(columns + n_in) - x_log_x(columns)
            to = int(np.argmax(gain))
            if gain[to] <= gain[was] + 1e-9:
                to = was
            table[:, to] += before
            table[to, :] += after
            table[to, to] += own
            if to != was:
                moved, of[w] = True, to
                left[:, was] -= bigrams[w]
                left[:, to] += bigrams[w]
                right[:, was] -= bigrams[:, w]
                right[:, to] += bigrams[:, w]
        if not moved:
            break
    return of[:m], table


def context_gains(table: np.ndarray, classes: int) -> np.ndarray:
    """What one neighbour of each class, before or behind, gains in each class of words."""
    smooth = table + 0.5
    gain = np.log(smooth * smooth.sum() / (smooth.sum(1, keepdims=True) * smooth.sum(0)))
    return np.concatenate([gain[:, :classes], gain[:classes, :].T])


def packed_contexts(pair: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and packed (context, count) of pairs word * wide + context."""
    pair, n = np.unique(pair, return_counts=True)
    most = (1 << COUNT_BITS) - 1
    parts = -(-n // most)  # a count beyond the bits becomes several
    pair, n, parts = (np.repeat(x, parts) for x in (pair, n, parts))
    if len(n) and parts.max() > 1:
        first = np.r_[True, pair[1:] != pair[:-1]]
        n = np.where(first, n - (parts - 1) * most, most)
    return pair // wide, (((pair % wide) << COUNT_BITS) + n).astype(np.uint32)


def other_words(blocks: DataFrame, core: dict[bytes, int], of: np.ndarray, table: np.ndarray, classes: int) -> DataFrame:
    """Per block and word outside the core: block, at, n (training count), class, lead.

    The contexts of a word in each block meet in one place, as classes; the word joins the class
    that they gain most in, ties the first. One row of each word is its lead.
    """
    wide = 2 * (classes + 2)
    sent = blocks.sparkSession.sparkContext.broadcast(({w: n for n, w in enumerate(core)}, np.append(of, classes), context_gains(table, classes)))
    other = len(core)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, class_of, _ = sent.value
        for batch in batches:
            for block, held, lengths, ids, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                listed = word_list(words)
                codes = codes_of(listed, known, other)
                rare = codes == other
                flat, size = training_part(held, lengths, ids)
                near = text_line(class_of[codes].astype(np.int64), flat, size, classes + 1)
                word = text_line(np.arange(len(listed)), flat, size, -1)
                at = np.flatnonzero((word >= 0) & np.append(rare, False)[word])
                word, context = packed_contexts(np.concatenate([word[at] * wide + near[at - 1], word[at] * wide + wide // 2 + near[at + 1]]), wide)
                rows = np.flatnonzero(rare)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(listed))[rows])]).astype(np.int32) * 4
                context = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(context.tobytes())])
                text = pa.array(listed, pa.binary()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [text, pa.array(np.full(len(rows), block)), pa.array(rows.astype(np.int32)), context], ["word", "block", "at", "context"]
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = sent.value[2]
        rest: list[pa.RecordBatch] = []

        def decided(rows: pa.Table) -> pa.RecordBatch:
            word, block, at, context = (c.combine_chunks() for c in rows.columns)
            first = np.ones(len(word), bool)
            first[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            no = np.cumsum(first) - 1
            found = np.frombuffer(b"".join(context.to_pylist()), np.uint32).astype(np.int64)
            cell = np.repeat(no, pc.binary_length(context).to_numpy() // 4) * wide + (found >> COUNT_BITS)
            seen = np.bincount(cell, found & ((1 << COUNT_BITS) - 1), minlength=(no[-1] + 1) * wide).reshape(-1, wide)
            total = seen[:, : wide // 2].sum(1).astype(np.int64)  # each token has one token before it
            best = (seen @ gains).argmax(1)
            return pa.RecordBatch.from_arrays(
                [block, at, pa.array(total[no]), pa.array(best[no].astype(np.int16)), pa.array(first)], ["block", "at", "n", "class", "lead"]
            )

        for batch in batches:
            word = batch.column(0)
            whole = int(np.argmax(pc.equal(word, word[-1]).to_numpy(zero_copy_only=False)))  # rows are sorted
            if rest and whole == 0 and rest[-1].column(0)[-1] == word[0]:
                rest.append(batch)
                continue
            ready = pa.Table.from_batches([*rest, batch.slice(0, whole)])
            rest = [batch.slice(whole)]
            if len(ready):
                yield decided(ready)
        if rest:
            yield decided(pa.Table.from_batches(rest))

    rows = blocks.select("block", "held", "lengths", "ids", "words").mapInArrow(contexts, "word binary, block long, at int, context binary")
    sorted_rows = rows.repartition(shuffle_partitions(blocks.sparkSession), "word").sortWithinPartitions("word", "block")
    return sorted_rows.mapInArrow(joined, "block long, at int, n long, class short, lead boolean")


def token_states(blocks: DataFrame, words: DataFrame, core: dict[bytes, int], of: np.ndarray, classes: int, train_docs: int) -> DataFrame:
    """Blocks with what is sure of their documents' scores, and counts of class transitions.

    ``base`` sums log10(c + 0.1), ``inside`` log10(c - DISCOUNT) over the known words; ``pairs``
    has each token's class behind the one before it, ``moves`` their training counts, ``kinds``
    the leading words of each class.
    """
    kind = blocks.schema["doc_ids"].dataType.simpleString()
    wide = classes + 2
    sent = blocks.sparkSession.sparkContext.broadcast(
        ({w: n for n, w in enumerate(core)}, np.append(np.array(list(core.values()), np.int64), 0), np.append(of, classes + 1))
    )
    other = len(core)

    def scored(doc_ids: pa.Array, held: bytes, lengths: bytes, ids: bytes, text: bytes, n: np.ndarray, cls: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
        known, core_n, core_class = sent.value
        codes = codes_of(word_list(text), known, other)
        count, state = core_n[codes], core_class[codes].astype(np.int64)
        rare = codes == other
        count[rare], state[rare] = n, np.where(n > 0, cls, classes + 1)
        out, size, flat = numbers(held, bool), numbers(lengths, np.int32), numbers(ids, np.int32)
        share = np.log10(np.append(count, train_docs) + 0.1)
        inside = np.zeros(len(count) + 1)
        sure = np.flatnonzero(count > 0)
        inside[sure] = np.log10(count[sure] - DISCOUNT)
        word = text_line(np.arange(len(count)), flat, size, len(count))
        states = np.append(state, classes)[word]
        pair = (states[:-1] * wide + states[1:]).astype(np.uint16)
        starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
        word = word[1:]
        learned = ~np.repeat(out, size + 1)
        moves = np.bincount(pair[learned], minlength=wide * wide)
        # Behind a word counted once it goes on as behind an unknown one.
        single = np.flatnonzero((np.append(count, 0)[word[:-1]] == 1) & learned[:-1])
        moves += np.bincount((classes + 1) * wide + states[single + 2], minlength=wide * wide)
        return pa.RecordBatch.from_arrays(
            [
                doc_ids, pa.array([held], pa.binary()), packed((size + 1).astype(np.int64)),
                packed(np.add.reduceat((np.append(count, train_docs) > 0)[word].astype(np.int64), starts)),
                packed(np.add.reduceat(share[word], starts)), packed(np.add.reduceat(inside[word], starts)),
                packed(pair), packed(moves), packed(np.bincount(cls[lead & (n > 0)], minlength=classes)),
            ],
            ["doc_ids", "held", "n_tokens", "n_known", "base", "inside", "pairs", "moves", "kinds"],
        )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            first = 0
            for own in [*np.flatnonzero(batch.column(1).to_numpy() == BEHIND), len(batch)]:
                for kept, column in zip(waiting, batch.columns[2:5], strict=True):
                    kept.append(column.slice(first, own - first).to_numpy(zero_copy_only=False).copy())
                first = own + 1
                if own < len(batch):
                    n, cls, lead = (np.concatenate(x) for x in waiting)
                    yield scored(batch.column(5).slice(own, 1), *(c[own].as_py() for c in batch.columns[6:]), n.astype(np.int64), cls.astype(np.int64), lead.astype(bool))
                    waiting = [[], [], []]

    texts = ["doc_ids", "held", "lengths", "ids", "words"]
    # Empty values instead of nulls, behind which Arrow's writer fills up its offsets row by row.
    own = blocks.select("block", F.lit(BEHIND).alias("at"), *[F.lit(x).cast(t).alias(c) for x, c, t in ((0, "n", "long"), (0, "class", "short"), (False, "lead", "boolean"))], *texts)
    empty = [F.array().cast(kind).alias("doc_ids"), *[F.lit(b"").alias(c) for c in texts[1:]]]
    both = words.select("block", "at", "n", "class", "lead", *empty).unionAll(own)
    both = both.repartition(shuffle_partitions(blocks.sparkSession), "block").sortWithinPartitions("block", "at")
    return cut_lineage(both.mapInArrow(
        gathered, f"doc_ids {kind}, held binary, n_tokens binary, n_known binary, base binary, inside binary, pairs binary, moves binary, kinds binary"
    ))


def counted_moves(states: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of class transitions, and distinct words of each class outside the core."""
    cells = (classes + 2) ** 2

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + classes, np.int64)
        for batch in batches:
            for moves, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total += np.concatenate([numbers(moves, np.int64), numbers(kinds, np.int64)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    sums = states.select("moves", "kinds").mapInArrow(summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(cells + classes)
    for row in sums.collect():  # at most one row a cell
        out[row["cell"]] = row["n"]
    return out[:cells].reshape(classes + 2, classes + 2), out[cells:]


def transition_logs(moves: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class behind each other, less that of the size of the
    class; of the end of a text; and of the unknown word."""
    classes = len(kinds)
    counts = moves[:, : classes + 1]
    sizes = counts[: classes + 1].sum(0)
    p = (counts + SHARE_WEIGHT * sizes / max(1.0, sizes.sum())) / (counts.sum(1, keepdims=True) + SHARE_WEIGHT)
    # The discount of a class is the share that it gives to the unknown word.
    left = np.append(DISCOUNT * kinds / np.maximum(sizes[:-1], 1), 0)
    inside = p / np.append(np.maximum(sizes[:-1], 1), 1)
    return np.log10(np.maximum(np.column_stack([inside, p @ left]), 1e-300))


def class_scores(docs: DataFrame, held: Column, classes: int = CLASSES, core_share: float = CORE_SHARE) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows that are not held out. Tokens are lower-cased (A-Z) words and one end; a
    null or empty text is the end alone. Repeated rows are scored, and learned, one by one. If
    nothing is learned, every score is that of the base, 0. An empty table gives no row. Other
    columns are ignored.
    """
    if 2 * (classes + 2) > 256:
        raise ValueError("a context of more than 126 classes does not fit")
    blocks = token_blocks(docs, held)
    size = blocks.agg(F.sum("train_docs").alias("docs"), F.sum("train_tokens").alias("tokens")).first()
    train_docs, words = size["docs"] or 0, size["tokens"] or 0
    train_tokens = words + train_docs
    core = core_words(blocks, core_share, max(1.0, train_tokens * core_share))
    of, table = exchange(core_bigrams(blocks, core), classes)
    states = token_states(blocks, other_words(blocks, core, of, table, classes), core, of, classes, train_docs)
    moves, kinds = counted_moves(states, classes)
    kinds += np.bincount(of, minlength=classes)
    distinct = int(kinds.sum()) + (train_docs > 0)
    less = np.log10(train_tokens + 0.1 * (distinct + 1))
    logs = docs.sparkSession.sparkContext.broadcast(transition_logs(moves, kinds).ravel())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0)
            for no, (held, n, known, base, inside, pairs) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                n = numbers(n, np.int64)
                base = numbers(base, float) - n * less
                starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                score = np.add.reduceat(logs.value[numbers(pairs, np.uint16)], starts) + numbers(inside, float)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(no, 1).flatten(), pa.array(numbers(held, bool)), pa.array(n), pa.array(numbers(known, np.int64)),
                        pa.array(np.full(len(n), train_tokens)), pa.array(base), pa.array(score if train_docs else base),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return states.select("doc_ids", "held", "n_tokens", "n_known", "base", "inside", "pairs").mapInArrow(
        finished, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
