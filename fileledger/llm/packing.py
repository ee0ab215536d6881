"""Best-fit packing of token sequences by bulk-synchronous rounds.

Documents are tokenized and cut into pieces. Pieces are range-sorted by length and ranked
inside their length by distributed prefix sums. A round sorts waiting pieces and gaps (open
sequences) by size and sweeps both from the largest down: each piece meets the tightest gap
not yet used in the round that holds it; of equal candidates the lower rank goes first. The
matched gaps shrink and the round repeats, until no piece fits; then as many sequences are
opened as the waiting tokens need at least.

Lengths and gaps are whole numbers up to the sequence length, so equal ones form runs of
consecutive ranks and sequence numbers. A round works on runs, of which there are few at any
input size; rows meet the result once, by their length and rank.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import hand_back, prefix_sums, tokenizer_file
from fileledger.session import cut_lineage

#: Distinct words whose ids a worker remembers.
REMEMBERED = 200_000


#: The steps before the merges of a tokenizer whose plain words can go to the merges directly.
KNOWN_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of printable Latin-1 characters without an apostrophe: those steps only lower their case
#: and cut them into runs of letters, single digits and runs of other signs.
PLAIN = re.compile(r"[!-&(-~\u00a1-\u00ff]+")
RUNS = re.compile(r"[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Remembered(dict):
    """A dictionary that finds what it lacks, and starts anew when full."""

    def __init__(self, most: int) -> None:
        self.most = most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.find(key)
        return found


class RunIds(Remembered):
    """Ids of runs of lower-case letters, digits or signs, straight from the merges."""

    def __init__(self, merge: Callable, most: int) -> None:
        super().__init__(most)
        self.merge, self.letters = merge, byte_letters()

    def find(self, run: str) -> bytes:
        # Printable ASCII stands for itself.
        merged = self.merge(run if run.isascii() else run.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(merged)}I", *[t.id for t in merged])


class WordIds(Remembered):
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a bounded memory of words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words. Words are cut at ASCII white space only; other spaces are left to the tokenizer.
    A new word goes through the whole tokenizer, except for plain words where the steps before
    the merges are the known ones: their runs go to the merges directly. Nothing refers back to
    this object, so its memory is free when its task ends.
    """

    def __init__(self, tokenizer_json: str, remembered: int = REMEMBERED) -> None:
        super().__init__(remembered)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.runs = RunIds(self.tokenizer.model.tokenize, remembered)
        steps = json.loads(tokenizer_json)
        normalizers = (steps["normalizer"] or {}).get("normalizers")
        cutters = (steps["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.direct = (
            normalizers == KNOWN_NORMALIZERS and cutters[0].get("pattern") == {"Regex": KNOWN_PATTERN}
            and [c["type"] for c in cutters] == ["Split", "ByteLevel"]
            and all("<|" in t["content"] for t in steps["added_tokens"])
        )

    def find(self, word: bytes) -> bytes:
        text = word.decode()
        if self.direct and PLAIN.fullmatch(text) and "<|" not in text:
            low = text.lower()
            # Letters of Latin-1 are one run.
            return self.runs[low] if low.isalpha() else b"".join(map(self.runs.__getitem__, RUNS.findall(low)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """Pieces of at most ``length`` tokens: doc_id, piece, start, length, ids_crc32."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(model.value)
        for batch in batches:
            at, piece, start, size, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = words.ids(text.as_py() or "") + end
                for no, first in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[first : first + 4 * length]
                    at.append(row), piece.append(no), start.append(first // 4)
                    size.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        del words
        hand_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds over runs: (length, first rank, rows, first sequence, offset) for each match of runs."""
    waiting = {n: [0, c] for n, c in counts.items() if c}
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened, out = 0, []
    while waiting:
        values = sorted(set(waiting) | set(gaps), reverse=True)
        kept: dict[int, list[tuple[int, int]]] = {}
        stack: list[list[int]] = []
        matched = False
        for v in values:
            stack += [[v, s, c] for s, c in gaps.get(v, ())]
            run = waiting.get(v)
            while run and run[1] and stack:
                free, seq, count = stack[-1]
                n = min(count, run[1])
                out.append((v, run[0], n, seq, capacity - free))
                matched = True
                run[0], run[1] = run[0] + n, run[1] - n
                if free > v:
                    kept.setdefault(free - v, []).append((seq, n))
                stack[-1][1:] = [seq + n, count - n]
                if not stack[-1][2]:
                    stack.pop()
        for free, seq, count in stack:
            kept.setdefault(free, []).append((seq, count))
        waiting = {n: r for n, r in waiting.items() if r[1]}
        gaps = {g: joined(runs) for g, runs in kept.items()}
        if not matched and waiting:
            need = -(-sum(n * c for n, (_, c) in waiting.items()) // capacity)
            gaps.setdefault(capacity, []).append((opened, need))
            opened += need
    return out


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Adjacent runs of sequence numbers as one."""
    out: list[tuple[int, int]] = []
    for seq, count in sorted(runs):
        if out and out[-1][0] + out[-1][1] == seq:
            out[-1] = (out[-1][0], out[-1][1] + count)
        else:
            out.append((seq, count))
    return out


def pack_documents(docs: DataFrame, length: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and then ``end_id``; only documents longer than ``length`` are
    cut. Null and empty texts are the end id alone. Rows with equal ids are packed separately;
    an empty table gives no piece; other columns are ignored.
    """
    pieces = cut_lineage(tokenized_pieces(docs, tokenizer or tokenizer_file("word_bpe_49k.json"), length, end_id))
    ranked = prefix_sums(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Full pieces need no search: each is a sequence of its own.
    runs = sorted(pack_runs({n: c for n, c in counts.items() if n < length}, length))
    behind = 1 + max((s + c for _, _, c, s, _ in runs), default=-1)
    runs += [(length, 0, counts[length], behind, 0)] if length in counts else []
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    place = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = place.value
        starts = (moves[:, 0] << 48) + moves[:, 1]
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in (3, 5))
            move = moves[np.searchsorted(starts, (n << 48) + rank, side="right") - 1]
            seq = move[:, 3] + rank - move[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(seq), pa.array(move[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
