"""Near-duplicates by SimHash and the Jaccard similarity of word shingle sets, without loss.

First come the SimHash fingerprints of the same shingles, linked at four or fewer differing bits by the index on positional
bytes (simhash.links). Each set is held against one of those that such links reach, and pairs whose whole sets are similar
enough are joined. Copies with few changes mostly meet here, by one pair a set, however large their group. Fingerprints of
64 bits neither link every pair of similar sets nor only such, so an index on the shingles themselves finds what is missing.

Two sets of similarity t or more share at least t of either, so, with all shingles in one order, the first
n - ceil(t n) + 1 of both have a shingle in common. An index on those finds every pair. Any order is right; the one
used puts shingles that are frequent in some rows last, so their lists stay short. A pair goes on if the rest of both
sets after the shared shingle is large enough, and if their bitmaps, in which each shingle turns one of 1,024 bits over,
differ in no more bits than the sets may in shingles. What is left is verified on whole sets.

Only groups are asked for, so pairs that are joined already need no look, nor do lists whose members all are. Other lists
hold their members against one of the component that has most of the list, drawn by hash: copies of one text share many
lists and so meet many of each other, which joins them by as many pairs as they have list entries. Rounds go on until what is left to compare is little or a round joins little: what is apart then are texts that reach the
threshold with few others of their list or with none, so all members of other components must be looked at. Their bitmaps
are compared within the task that holds the list, in blocks, and only pairs that these leave become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import Stored, stored
from codegrain.llm.components import components, first_of_groups, label_groups, numbered
from codegrain.llm.simhash import SEED, as_bytes, fingerprint_of, links, shingle_hashes, texts

#: Share of the rows on which frequent shingles are counted (ORDER_ROWS at least) and how many shingles are held; the pairs
#: found don't depend on them.
ORDER_SHARE, ORDER_ROWS, ORDER_SHINGLES = 0.1, 10_000, 1_000_000
BITS = 1024
#: Sets that are held against the same one where fingerprints link them.
STAR = 256


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, np.int64)


def shingles(text: str | bytes | memoryview | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; fewer words are one shingle, no words none."""
    return _distinct(list(shingle_hashes(text.encode() if isinstance(text, str) else text or b"", k)))


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def bitmap(found: np.ndarray) -> bytes:
    """Bits turned over by an odd number of shingles: two bitmaps differ in no more bits than their sets in shingles."""
    return np.packbits(np.bincount(found & (BITS - 1), minlength=BITS) % 2 == 1).tobytes()


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else np.empty(0, np.int64), pa.int64()))


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the set of each text and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingles(as_bytes(t), k) for t in batch.column(0).slice(at, 512)]
                nodes = np.array([_node(x) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), _lists(found)], names=["node", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, shingles array<long>")


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that several of some rows hold, and the number of those rows."""
    share = min(1.0, max(ORDER_SHARE, ORDER_ROWS / max(1, docs.count())))
    drawn = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30)) < int(share * (1 << 30))
    often = sets(docs.where(drawn), k).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    rows = often.orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).toArrow()  # 12 bytes each
    names, counts = rows.column("s").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(names)
    return names[order], counts[order]


def prefix(found: np.ndarray, order: tuple[np.ndarray, np.ndarray], least: tuple[int, int]) -> np.ndarray:
    names, counts = order
    rank = np.zeros(len(found), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, found), len(names) - 1)
        rank = np.where(names[at] == found, counts[at], 0)
    n, (p, q) = len(found), least
    return found[np.lexsort((found, rank))[: n - -(-p * n // q) + 1]] if n else found


def indexed(docs: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """(doc_id, row, node, size, prefix, bits, print) of each row; print is the SimHash fingerprint as a signed long."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))  # ORDER_SHINGLES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, prints = [], []
                for t in part.column(2):
                    hashes = list(shingle_hashes(as_bytes(t), k))
                    found.append(_distinct(hashes))
                    prints.append(fingerprint_of(hashes))
                nodes, prints = (np.array(x, np.uint64).view(np.int64) for x in (list(map(_node, found)), prints))
                columns = [*part.columns[:2], pa.array(nodes), pa.array([len(x) for x in found], pa.int32()), _lists([prefix(x, sent.value, least) for x in found]), pa.array(map(bitmap, found), pa.binary()), pa.array(prints)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "size", "prefix", "bits", "print"])

    return texts(docs).mapInArrow(run, "doc_id long, row long, node long, size int, prefix array<long>, bits binary, print long")


def alike(prints: DataFrame, keep: Stored) -> DataFrame:
    """(a, b): pairs of nodes that links between fingerprints join, for distinct prints (node, print).

    A group of n nodes gets fewer than n pairs: its nodes are dealt to stars of about STAR by a hash, and the middles of the
    stars are held against one of them. So no task gets a whole large group where pairs are joined.
    """
    ids = keep(prints.select(F.col("print").alias("node"), F.col("print").alias("id")).distinct())
    joined = components(links(ids)).select(F.col("id").alias("print"), "component")
    member = keep(prints.join(joined, "print", "left").select("node", F.coalesce("component", "print").alias("group")).distinct())
    sizes = member.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    placed = member.join(sizes, "group").select("group", "node", "first", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / STAR)).alias("star"))
    middles = keep(placed.groupBy("group", "star").agg(F.min("node").alias("middle"), F.first("first").alias("first")))
    rays = placed.join(middles.select("group", "star", "middle"), ["group", "star"]).select(F.col("node").alias("a"), F.col("middle").alias("b"))
    both = rays.unionByName(middles.select(F.col("middle").alias("a"), F.col("first").alias("b"))).where("a <> b")
    out = keep(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    keep.drop(ids, member, middles)
    return out


def shared_lists(prints: DataFrame) -> DataFrame:
    """(list, node, size, rest): the lists of two nodes or more.

    rest is the number of shingles of the node from this one on.
    """
    listed = prints.select("node", "size", F.posexplode("prefix").alias("pos", "list")).select("list", "node", "size", (F.col("size") - F.col("pos")).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                now = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
                held = now if held is None else np.concatenate([held, now], axis=1)
                cut = int(np.searchsorted(held[0], held[0, -1]))  # the last list may go on
            elif held is not None:
                cut = held.shape[1]
            else:
                return
            done, held = held[:, :cut], held[:, cut:]
            if not cut:
                continue
            done = done[:, np.concatenate([[True], (done[0, 1:] != done[0, :-1]) | (done[1, 1:] != done[1, :-1])])]
            first = np.flatnonzero(np.concatenate([[True], done[0, 1:] != done[0, :-1]]))
            n = np.diff(np.append(first, done.shape[1]))
            many = np.repeat(n > 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(done[0, many]), pa.array(done[1, many]), *(pa.array(done[i, many].astype(np.int32)) for i in (2, 3))], names=["list", "node", "size", "rest"])

    return listed.repartition("list").sortWithinPartitions("list", "node").mapInArrow(run, "list long, node long, size int, rest int")


def possible(pairs: DataFrame, maps: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that the bitmaps of their sets, maps (node, size, bits), do not rule out."""
    p, q = least
    left, right = (maps.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("bits").alias(f"m{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (4, 5))
            differ = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            size = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(differ * (p + q) <= size * (q - p)))

    return both.mapInArrow(run, "a long, b long")


def crossing(rows: DataFrame, maps: DataFrame, least: tuple[int, int], block: int = 512) -> DataFrame:
    """(a, b), each pair once: members of different components of a list, rows of several(), that neither what follows the
    list's shingle nor their bitmaps, maps (node, size, bits), rule out. A list of more than `block` members is cut into blocks
    by a hash of the node, and its pairs of blocks go to different tasks, so a task holds at most two blocks of a list."""
    p, q = least
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = rows.select("list", "node", "size", "rest", "c", (F.col("c") != F.col("main")).alias("apart"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = placed.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "node", "size", "rest", "c", "apart")
    mapped = cells.join(maps.select("node", "bits"), "node").select("list", "low", "high", "second", "node", "size", "rest", "c", "apart", "bits")

    def compared(rows_of: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows_of)
        second, node, size, rest, c, apart = (t.column(name).to_numpy() for name in ("second", "node", "size", "rest", "c", "apart"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        size, rest = size.astype(np.int64), rest.astype(np.int64)
        same = t.column("low")[0] == t.column("high")[0]
        every = np.arange(len(node))
        sides = [(every, every[apart])] if same else [(every[~second & apart], every[second]), (every[~second & ~apart], every[second & apart])]
        for left, right in sides:
            for at in range(0, len(left), 64) if len(right) else ():
                a = left[at : at + 64]
                total = size[a][:, None] + size[right]
                ok = (c[a][:, None] != c[right]) & (np.minimum(rest[a][:, None], rest[right]) * (p + q) >= total * p)
                i, j = np.nonzero(ok)
                differ = np.bitwise_count(bits[a[i]] ^ bits[right[j]]).sum(axis=1, dtype=np.int64)
                near = differ * (p + q) <= total[i, j] * (q - p)
                x, y = node[a[i[near]]], node[right[j[near]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if held and tuple(keys[begin]) != at:
                    yield from compared(held)
                    held = []
                at = tuple(keys[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from compared(held)

    return mapped.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, least: tuple[int, int], keep: Stored) -> DataFrame:
    """The pairs (a, b), stored, whose whole sets are similar enough; nodes are numbered, each with a row that has its set."""
    p, q = least
    asked = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("asked_id"), F.col("row").alias("asked_row"))
    of = texts(docs)
    chosen = of.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("row") == F.col("asked_row")), "left_semi").select("text")
    held = keep.held(sets(chosen, k).dropDuplicates(["node"]))
    left, right = (held.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb")) * (p + q)
    out = keep(pairs.join(left, "a").join(right, "b").where(both >= p * (F.size("sa") + F.size("sb"))).select("a", "b"))
    keep.drop(held)
    return out


def several(shared: DataFrame, edges: DataFrame, keep: Stored) -> DataFrame:
    """(list, node, size, rest, c, n, others, main), stored: the lists whose nodes the edges leave in several components c.
    n nodes are in the list, others of them not in its main component, the one that has most."""
    joined = components(edges).withColumnRenamed("id", "node")
    marked = keep.held(shared.select("list", "node", "size", "rest").join(joined, "node", "left").select("list", "node", "size", "rest", F.coalesce("component", "node").alias("c")))
    sizes = marked.groupBy("list", "c").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("list").agg(F.sum("k").alias("n"), F.max(F.struct("k", "c")).alias("most")).where("most.k < n")
    out = keep(marked.join(mixed.select("list", "n", (F.col("n") - F.col("most.k")).alias("others"), F.col("most.c").alias("main")), "list"))
    keep.drop(marked)
    return out


def _labelled(docs: DataFrame, shingle: int, least: tuple[int, int], rounds: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, numbered nodes, their labels). Tables go as soon as the next one stands."""
    p, q = least
    keep = Stored(docs.sparkSession)
    whole = keep(indexed(docs, shingle, least))
    prints = stored(whole.select("doc_id", "row", "node"))
    nodes = numbered(prints)
    shared = keep(shared_lists(whole))
    first = alike(whole.select("node", "print").distinct(), keep)
    maps = keep(whole.join(shared.select("node").distinct(), "node", "left_semi").select("node", "size", "bits").distinct())
    keep.drop(whole)
    fit = lambda ra, rb, na, nb: f"least({ra}, {rb}) * {p + q} >= ({na} + {nb}) * {p}"  # as many shingles as must be shared
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    asked = keep(possible(first, maps, least))  # similar sets share a list, so nodes without maps have none
    keep.drop(first)
    edges = verified(asked, docs, nodes, shingle, least, keep)
    entries, former = shared.count(), None
    for turn in range(rounds):
        rows = several(shared, edges, keep)
        heads = rows.groupBy("list").agg(F.first("n").alias("n"), F.first("others").alias("others"))
        work = heads.agg(F.coalesce(F.sum(F.col("n") * F.col("others")), F.lit(0))).first()[0]
        # another round pays while it joins what the lists still hold apart
        last = work <= entries or turn == rounds - 1 or former is not None and work > 0.7 * former
        former = work
        if last:
            new = keep(crossing(rows, maps, least).join(asked, ["a", "b"], "left_anti"))
        else:
            drawn = F.min_by(F.struct("node", "size", "rest"), F.xxhash64(F.lit(turn), "list", "node"))
            heads = rows.where("c = main").groupBy("list").agg(drawn.alias("h"), F.first("main").alias("cb"))
            every = heads.select("list", F.col("h.node").alias("b"), F.col("h.size").alias("nb"), F.col("h.rest").alias("rb"), "cb")
            others = rows.where("c <> main").select("list", F.col("node").alias("a"), F.col("size").alias("na"), F.col("rest").alias("ra"), F.col("c").alias("ca"))
            pairs = others.join(every, "list").where("ca <> cb and " + fit("ra", "rb", "na", "nb")).select(*ordered("a", "b")).distinct()
            new = keep(possible(pairs.join(asked, ["a", "b"], "left_anti"), maps, least))
        found = verified(new, docs, nodes, shingle, least, keep)
        before, edges = (edges, found), keep(edges.unionByName(found))
        keep.drop(rows, *before)
        if last:
            break
        more = keep(asked.unionByName(new))
        keep.drop(asked, new)
        asked = more
    keep.drop(shared, maps, asked)
    ids = [nodes.select(F.col("node").alias(x), F.col("id").alias(f"i{x}")) for x in "ab"]
    return prints, nodes, label_groups(nodes, edges.join(ids[0], "a").join(ids[1], "b").select(F.col("ia").alias("a"), F.col("ib").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, component_id, of links at Jaccard similarity p/q or more.

    component_id is the smallest doc_id reachable by links, nulls aside. Equal sets enter once; texts without words are
    one group. Rows that share a doc_id are linked by their own texts; no rows, no result.
    """
    prints, _, labelled = _labelled(docs, shingle, least)
    return prints.select("doc_id", "node").join(labelled, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents, one row of each group of near-duplicates, all columns as they were: the row with the smallest
    doc_id, nulls last, and of rows that share it the one with the smallest hash. No rows, no result."""
    prints, nodes, labelled = _labelled(docs, shingle, least)
    return first_of_groups(docs, prints, nodes, labelled)
