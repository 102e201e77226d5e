"""Best-fit decreasing packing of documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so the plan of best-fit decreasing follows from how many pieces there
are of each length: pieces of one length are interchangeable, and so are bins with the same room. The driver plans on
that histogram with a segment tree over remaining capacities (the tightest open bin for a length is the leftmost leaf
at or right of it that holds bins: logarithmic). The plan is a list of runs, each saying that the pieces ranked a to b
among those of their length go, q to a bin, into consecutive bins. Executors rank the pieces and look their place up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import stored
from codegrain.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANKED = PIECES + ", part int, rank_in_part long"
PACKED = PIECES + ", sequence_id long, offset long"


class RoomTree:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open bins with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest room of an open bin that is at least length."""
        at = self.size + length
        if self.count[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces to a bin, first bin, offset of the first piece in its bin).

    counts: pieces of each length, 1..capacity. Longest first; pieces of one length fill the tightest bin as far as it
    goes before the next. Bins of equal room are kept as intervals of bin numbers, so the work depends on the number of
    lengths and not of pieces.
    """
    tree, open_bins, bins, runs = RoomTree(capacity), {}, 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            tree.add(room, n)
            open_bins.setdefault(room, []).append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # new bins, as many as the rest needs
                room, n, first = capacity, -(-left // (capacity // length)), bins
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                rest = min(left, each)
                if rest:
                    runs.append((length, rank, rest, each, first + full, capacity - room))
                    rank, left = rank + rest, left - rest
                put(room - rest * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
    return runs


def cut(docs: DataFrame, tokenizer: str, joined: bool, capacity: int, end_id: int, literal: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens of each document, its end id counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, joined, literal), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task come sorted by length; each gets its place among those of its length."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(3).to_numpy()
        begins = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
        rank = np.arange(len(lengths)) - np.repeat(begins, np.diff(np.r_[begins, len(lengths)]))
        if lengths[0] == last:
            rank[: begins[1] if len(begins) > 1 else None] += seen
        last, seen = lengths[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part), pa.int32()), pa.array(rank, pa.int64())], names=[c.split()[0] for c in RANKED.split(", ")])


def pack(docs: DataFrame, tokenizer: str, joined: bool = False, capacity: int = 2048, end_id: int = 0, literal: bool = False) -> DataFrame:
    """Packs documents (doc_id, text) into sequences; one row for each piece.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come; a null doc_id is packed
    like any other; other columns are ignored. No documents, no rows. With literal, control strings of the vocabulary in a
    text are ordinary text; else they become their ids.
    """
    spark = docs.sparkSession
    pieces = stored(cut(docs, tokenizer, joined, capacity, end_id, literal))
    keys = ["length", "doc_id", "piece", "ids_crc32"]
    ranked = stored(pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_ranked, RANKED))
    # tasks hold ranges of lengths, so there are at most as many rows as tasks and lengths together
    found = sorted((r["length"], r["part"], r["n"]) for r in ranked.groupBy("length", "part").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = {}
    base = {}
    for length, part, n in found:
        base[length, part] = counts.get(length, 0)
        counts[length] = base[length, part] + n
    by_length: dict[int, list] = {}
    for length, rank, n, each, first, offset in plan(counts, capacity):
        by_length.setdefault(length, []).append((rank, n, each, first, offset))
    # runs and bases depend on the capacity and the number of tasks, never on the number of pieces of a length
    sent = spark.sparkContext.broadcast((base, {k: ([r[0] for r in v], v) for k, v in by_length.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, runs = sent.value
        for batch in batches:
            bins, offsets = [], []
            for length, part, rank in zip(*(batch.column(i).to_pylist() for i in (3, 5, 6)), strict=True):
                at = base[length, part] + rank
                firsts, of = runs[length]
                rank0, _, each, first, offset = of[bisect_right(firsts, at) - 1]
                bins.append(first + (at - rank0) // each)
                offsets.append(offset + (at - rank0) % each * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=[c.split()[0] for c in PACKED.split(", ")])

    return ranked.mapInArrow(run, PACKED)
