"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by Hamming distance.

A fingerprint has eight byte positions. Fingerprints that differ in at most four bits differ in at most four bytes, so
they share at least four positional bytes. The inverted index lists fingerprints by positional bytes. A list for one
position and byte would hold a 256th of all fingerprints, so the index is kept for sets of three positions at once:
twenty of them, by a covering design, are such that any four positions contain one. Each pair that shares four
positional bytes thus meets in a list of about a 16-millionth of all. Within a list the shared positional bytes of
each pair are tallied; pairs that reach the guaranteed minimum of four are verified by counting differing bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import row_hash, stored
from codegrain.llm.components import first_of_groups, label_groups, numbered

SEED = 42
#: Bytes of a text that are in words at a time.
PIECE = 1 << 17
_GAP = re.compile(rb"[\t-\r ]")


def shingle_hashes(text: bytes | memoryview, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the runs of k words in order, repeats included, in pieces; fewer words are one run, no words none.

    Only A-Z are lower-cased and only ASCII white space parts words, so bytes will do. The text is cut at white space and
    the last words of a piece are carried on, so memory doesn't grow with the text.
    """
    digest, carried, at, some = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        words = carried + bytes(text[at:end]).lower().split()
        at = end
        if len(words) < k:
            carried = words
            continue
        line = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], stops[:-1] + 1])[: len(words) - k + 1]
        yield np.array([digest(line[b:e], SEED) for b, e in zip(starts.tolist(), stops[k - 1 :].tolist(), strict=True)], np.uint64)
        carried, some = words[len(words) - k + 1 :], True
    if carried and not some:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def as_bytes(text: pa.StringScalar) -> bytes | memoryview:
    """A text as it lies in its batch; nothing for null."""
    held = text.as_buffer()
    return b"" if held is None else memoryview(held)


def fingerprint(text: str | bytes | memoryview | None, shingle: int = 4) -> int:
    """A bit is set if it is set in over half the shingle hashes; no words, no bit."""
    return fingerprint_of(shingle_hashes(text.encode() if isinstance(text, str) else text or b"", shingle))


def fingerprint_of(pieces: Iterable[np.ndarray]) -> int:
    """The same of hashes that come in pieces, repeats included."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        total += np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text) of documents."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.col("text").cast("string").alias("text"))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row, node): the fingerprint of each whole text, as a signed long; row tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(as_bytes(t), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], names=["doc_id", "row", "node"])

    return texts(docs).mapInArrow(run, "doc_id long, row long, node long")


def position_sets(n: int = 8) -> list[tuple[int, ...]]:
    """Triples of positions such that any four positions contain one: with the positions in three groups round a ring,
    those inside a group, and those with two in one group and one in the next."""
    group = lambda p: p % 3
    out = []
    for triple in combinations(range(n), 3):
        has = [sum(group(p) == g for p in triple) for g in range(3)]
        if 3 in has or any(has[g] == 2 and has[(g + 1) % 3] == 1 for g in range(3)):
            out.append(triple)
    return out


def forest(prints: np.ndarray, most: int, least_shared: int) -> list[tuple[int, int]]:
    """Edges, as places, that join the unsigned fingerprints of one list as their links do: a star for each group of
    linked ones.

    Each fingerprint is compared with those that no group has taken yet, so copies of one text, most of which link to
    the first, don't cost all their pairs.
    """
    out, rest = [], np.arange(len(prints))
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            differ = prints[rest] ^ prints[todo.pop()]
            tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= least_shared
            near[near] = np.bitwise_count(differ[near]) <= most
            if near.any():
                linked = rest[near]
                out += [(first, x) for x in linked]
                todo += list(linked)
                rest = rest[~near]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The (node, id) columns of each group: rows come sorted by their first column."""
    key, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, pairs = batch.column(0).to_numpy(), np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if kept and keys[begin] != key:
                yield np.concatenate(kept, axis=1) if len(kept) > 1 else kept[0]
                kept = []
            key = keys[begin]
            kept.append(pairs[:, begin:end])
    if kept:
        yield np.concatenate(kept, axis=1)


def links(nodes: DataFrame, most: int = 4, block: int = 1024) -> DataFrame:
    """(a, b): edges between the ids of distinct fingerprints (id long, node long) that join them as all pairs with at most
    `most` differing bits do.

    Lists of more than `block` fingerprints are cut into blocks, and each pair of blocks is a group of its own, so no
    task gets a whole long list; the join that tells how long a list is has no state, so a long one is dealt to several
    tasks there too.
    """
    if most > 4:
        raise ValueError("the index guarantees pairs up to four differing bits")
    byte = [F.shiftrightunsigned("node", 8 * p).bitwiseAND(255) for p in range(8)]
    keys = [F.lit(i << 24) + byte[x] * 65536 + byte[y] * 256 + byte[z] for i, (x, y, z) in enumerate(position_sets())]
    listed = nodes.select("node", "id", F.explode(F.array(*keys)).alias("list"))
    sizes = listed.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks)
    pairs = F.when(F.col("n") <= block, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(mine, j) * 1_000_000 + F.greatest(mine, j)))
    groups = listed.join(sizes, "list").select("list", "node", "id", F.explode(pairs).alias("pair")).select(F.xxhash64("list", "pair").alias("group"), "list", "pair", "node", "id")
    cut = groups.repartition("group").sortWithinPartitions("group", "list", "pair").select("group", "node", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for node, ids in _groups(batches):
            if len(node) == 2:
                a, b = node.tolist()
                if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= most:
                    out.append(ids.tolist())
            elif len(node) > 2:
                star = forest(np.ascontiguousarray(node).view(np.uint64), most, 8 - most)
                if star:
                    out += ids[np.array(star)].tolist()
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return cut.mapInArrow(run, "a long, b long")


def _labelled(docs: DataFrame, shingle: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    prints = stored(fingerprints(docs, shingle))
    nodes = numbered(prints)
    return prints, nodes, label_groups(nodes, links(nodes.select("id", "node"), most))


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero, which links like any other. component_id is the smallest doc_id
    reachable by links, nulls aside: a group in which every doc_id is null has none. Repeated rows each get a row, rows
    that share a doc_id are linked by their own texts; other columns are ignored; no rows, no result. Copies share a
    fingerprint and enter the search once. A text's words are in memory a piece at a time, however long it is.
    """
    prints, _, labelled = _labelled(docs, shingle, most)
    return prints.join(labelled, "node").select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """The documents, one row of each group of near-duplicates, all columns as they were: the row with the smallest
    doc_id, nulls last, and of rows that share it the one with the smallest hash. Groups are made of rows, not of ids:
    rows without a doc_id or with the same one go only if their texts are linked. No rows, no result."""
    prints, nodes, labelled = _labelled(docs, shingle, most)
    return first_of_groups(docs, prints, nodes, labelled)
