"""Near-duplicate embeddings by tiled cosine comparison in principal-component order.

Unit vectors are turned into the basis of their principal components, the largest first, so that the first dimensions
hold as much of a product as any can. Vectors are dealt to blocks that are boxes in the leading dimensions; two blocks
are compared only if the boxes, and the largest norms of what is left of their vectors, allow a product that reaches
the threshold. A tile compares parts of two blocks. It takes the products of the leading dimensions and bounds the rest
by the product of the norms of what is left of each vector (Cauchy-Schwarz); the norms ride along as one more dimension,
so one matrix product gives the bounds. Pairs whose bound is below the threshold stop there; the others go on with
further dimensions. All this is in single precision with slack; what is left is verified on the vectors as they came,
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.llm.common import stored
from codegrain.llm.components import label_groups

#: Above what single-precision products of unit vectors can be off by.
SLACK = 1e-4
#: Share of a tile's pairs from which one product of all dimensions is cheaper than going on pair by pair.
DENSE = 0.02
#: Vectors by which the boxes are laid out; a poor layout costs time, never a pair.
LAYOUT_ROWS = 20_000
#: Leading dimensions that boxes are made of.
BOX_DIMS = 8


def _rows(batch_column, dims: int) -> np.ndarray:
    """Vectors in double precision, shorter ones padded with zeros, each scaled by a power of two, which rounds nothing,
    so that squares neither vanish nor overflow."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = batch_column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims))
    if len(flat):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[rows, cols] = flat
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, keepdims=True))[1])


def _unit(batch_column, dims: int) -> np.ndarray:
    out = _rows(batch_column, dims)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def basis(vectors: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of all vectors, largest first, as columns. The driver gets dims x dims sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _unit(batch.column(0).slice(at, 4096), dims)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims), pa.int32()), pa.array(total.reshape(-1), pa.float64())], names=["at", "part"])

    sums = vectors.select("embedding").mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    total = np.zeros(dims * dims)
    for row in sums:
        total[row["at"]] = row["part"]
    return np.linalg.eigh(total.reshape(dims, dims))[1][:, ::-1]


def spanning(linked: np.ndarray) -> list[tuple[bool, int, bool, int]]:
    """For a tile of links, stars (side, place, side, place) that join rows (side False) and columns as the links do."""
    out = []
    rows_left, cols_left = linked.any(axis=1), linked.any(axis=0)
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        todo = [(False, int(start))]
        while todo:
            side, at = todo.pop()
            left = rows_left if side else cols_left
            found = np.flatnonzero((linked[:, at] if side else linked[at]) & left)
            left[found] = False
            new = [(not side, int(x)) for x in found]
            out += [(False, int(start), *x) for x in new]
            todo += new
    return out


def _residue(x: np.ndarray, k: int) -> np.ndarray:
    """Norms of what unit vectors have after the first k dimensions."""
    return np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x[:, :k], x[:, :k], dtype=np.float64)))


def compare(x: np.ndarray, y: np.ndarray, raw: tuple[np.ndarray, np.ndarray], threshold: float, steps: tuple[int, ...]) -> np.ndarray:
    """Which rows of x link to which of y: both are unit vectors in principal order, single precision, and raw holds the
    same vectors as they came, in double precision, which decide."""
    lead = steps[0]
    bounded = lambda v: np.c_[v[:, :lead], _residue(v, lead)].astype(np.float32)
    near = bounded(x) @ bounded(y).T >= threshold - SLACK
    linked = np.zeros(near.shape, bool)
    if not near.any():
        return linked
    left, right = (np.linalg.norm(v, axis=1) for v in raw)
    if near.mean() > DENSE:
        return (raw[0] @ raw[1].T) / (left[:, None] * right) >= threshold
    rows, cols = np.nonzero(near)
    done, part = lead, np.einsum("ij,ij->i", x[rows, :lead], y[cols, :lead], dtype=np.float64)
    for step in steps[1:]:
        part += np.einsum("ij,ij->i", x[rows, done:step], y[cols, done:step], dtype=np.float64)
        stay = part + _residue(x, step)[rows] * _residue(y, step)[cols] >= threshold - SLACK
        rows, cols, part, done = rows[stay], cols[stay], part[stay], step
    exact = np.einsum("ij,ij->i", raw[0][rows], raw[1][cols]) / (left[rows] * right[cols]) >= threshold
    linked[rows[exact], cols[exact]] = True
    return linked


def layout(x: np.ndarray, blocks: int) -> list[tuple[int, float]]:
    """Cuts (dimension, value) of a tree that halves the rows of x, in principal order, down to at least that many leaves;
    node i has the children 2 i and 2 i + 1. Each cut goes through the dimension in which the rows of its node spread most."""
    depth = max(0, blocks - 1).bit_length()
    held, cuts = {1: x}, [(0, 0.0)] * (1 << depth)
    for at in range(1, 1 << depth):
        part = held.pop(at)
        d = int(part.var(axis=0).argmax()) if len(part) else 0
        value = float(np.median(part[:, d])) if len(part) else 0.0
        cuts[at] = (d, value)
        if 2 * at < 1 << depth:
            low = part[:, d] < value
            held[2 * at], held[2 * at + 1] = part[low], part[~low]
    return cuts


def leaf(x: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each row, from 0."""
    dim, value = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts])
    at = np.ones(len(x), np.int64)
    for _ in range(len(cuts).bit_length() - 1):
        at = 2 * at + (x[np.arange(len(x)), dim[at]] >= value[at])
    return at - len(cuts)


def close_boxes(low: np.ndarray, high: np.ndarray, rest: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs i <= j of boxes (bounds of the leading dimensions, largest norm of what follows) that a link may join."""
    out = []
    for i in range(len(low)):
        ends = [a[i] * b[i:] for a in (low, high) for b in (low, high)]
        most = np.maximum.reduce(ends).sum(axis=1) + rest[i] * rest[i:]
        out += [(i, i + int(j)) for j in np.flatnonzero(most >= threshold - SLACK)]
    return out


def near_links(vectors: DataFrame, dims: int, threshold: float, block: int = 32_768, tile: int = 1024) -> DataFrame:
    """(a, b, n) over distinct vectors (node long, n copies long, embedding).

    Rows with b null: node a links n vectors in one pair of blocks, copies counted, its own not. Others: edges that
    join nodes as the links do, at most a star for each tile and group and never all pairs of a group. A block has about
    `block` vectors, fewer where there would be too few pairs of blocks for the cluster, more beyond 2,048 blocks.
    """
    spark = vectors.sparkSession
    count = vectors.count()
    axes = spark.sparkContext.broadcast(basis(vectors, dims))  # dims x dims
    few = int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism)))
    blocks = max(1, min(2048, max(-(-count // block), min(-(-count // (2 * tile)), few))))
    steps = tuple(sorted({max(1, min(dims, dims // 4)), max(1, dims // 2), dims}))
    led = min(BOX_DIMS, dims)

    drawn = vectors.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, LAYOUT_ROWS / max(1, count)) * (1 << 30))).select("embedding").toArrow()  # about LAYOUT_ROWS vectors
    some = np.concatenate([np.zeros((0, dims)), *(_unit(c, dims) for c in drawn.column(0).chunks if len(c))]) @ axes.value
    cuts = layout(some[:, :led], blocks)
    slim = vectors.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_unit(batch.column(2), dims) @ axes.value)[:, :led] if batch.num_rows else np.zeros((0, led))
            lead = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * led, pa.int32()), pa.array(x.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf(x, cuts), pa.int32()), lead, pa.array(_residue(x, led), pa.float64())], names=["node", "n", "embedding", "mine", "lead", "rest"])

    placed = stored(vectors.select("node", "n", "embedding").mapInArrow(place, f"node long, n long, embedding {slim}, mine int, lead array<double>, rest double"))
    ends = [of(F.col("lead")[d]).alias(f"{name}{d}") for d in range(led) for name, of in (("low", F.min), ("high", F.max))]
    boxes = sorted(placed.groupBy("mine").agg(F.max("rest").alias("rest"), *ends).collect(), key=lambda r: r["mine"])  # a row for each block
    low, high = (np.array([[r[f"{name}{d}"] for d in range(led)] for r in boxes]).reshape(len(boxes), led) for name in ("low", "high"))
    asked = close_boxes(low, high, np.array([r["rest"] for r in boxes]), threshold)
    tickets: dict[int, list[tuple[int, bool, bool]]] = {}
    for k, (i, j) in enumerate(asked):
        tickets.setdefault(boxes[i]["mine"], []).append((k, False, i == j))
        if i != j:
            tickets.setdefault(boxes[j]["mine"], []).append((k, True, False))
    # a list for each block, as long as the blocks it is compared with
    dealing = spark.createDataFrame(list(tickets.items()), "mine int, tickets array<struct<pair:int,second:boolean,same:boolean>>")
    dealt = placed.join(F.broadcast(dealing) if len(asked) < 100_000 else dealing, "mine").select(F.inline("tickets"), "node", "n", "embedding")

    def tiles(second: np.ndarray, same: bool, node: np.ndarray, n: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = (raw / np.linalg.norm(raw, axis=1, keepdims=True) @ axes.value).astype(np.float32)
        a = np.arange(len(node)) if same else np.flatnonzero(~second)
        b = a if same else np.flatnonzero(second)
        counts = np.zeros(len(node), np.int64)
        edges: list[tuple[int, int]] = []
        for i in range(0, len(a), tile):
            for j in range(i if same else 0, len(b), tile):
                ai, bj = a[i : i + tile], b[j : j + tile]
                linked = compare(x[ai], x[bj], (raw[ai], raw[bj]), threshold, steps)
                if same and i == j:
                    np.fill_diagonal(linked, False)
                rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                if not len(rows):
                    continue
                linked, ai, bj = linked[np.ix_(rows, cols)], ai[rows], bj[cols]
                np.add.at(counts, ai, linked @ n[bj])
                if not (same and i == j):
                    np.add.at(counts, bj, n[ai] @ linked)
                of = {False: node[ai], True: node[bj]}
                edges += [(int(of[s][p]), int(of[t][q])) for s, p, t, q in spanning(linked)]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[node[some], np.array([e[0] for e in edges], np.int64)], pa.int64()), pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()), pa.array(np.r_[counts[some], np.zeros(len(edges), np.int64)], pa.int64())],
            names=["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, kept = None, []

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(kept).combine_chunks()
            get = lambda name: t.column(name).to_numpy()
            yield from tiles(get("second"), bool(t.column("same")[0].as_py()), get("node"), get("n"), np.concatenate([_rows(c, dims) for c in t.column("embedding").chunks]))

        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if kept and keys[begin] != pair:
                    yield from close()
                    kept = []
                pair = keys[begin]
                kept.append(batch.slice(begin, end - begin))
        if kept:
            yield from close()

    parts = max(1, min(len(asked), 8192))
    return dealt.repartitionById(parts, F.col("pair") % parts).sortWithinPartitions("pair").mapInArrow(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per row of embeddings (vec_id, embedding): vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing; shorter vectors count
    as padded with zeros. Equal vectors link with each other; they enter the comparison once. component_id is the
    smallest vec_id reachable, kept says that it is the row's own; a group of null ids only has none. Rows that share a
    vec_id are vectors of their own, each with its own links. Other columns are ignored; no rows, no result.
    """
    sound = F.coalesce(F.exists("embedding", lambda v: (v != 0)) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    kind = rows.schema["embedding"].dataType
    as_is = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    vector = F.col("embedding") if as_is else F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).withColumn("sound", sound)
    good = rows.where("sound").drop("sound")
    # written once, so that the numbers stay; they rise in the order of the first vec_id
    firsts = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    order = (F.col("first").asc_nulls_last(), F.xxhash64("embedding"))
    distinct = stored(firsts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    dims = distinct.agg(F.max(F.size("embedding"))).first()[0] or 1
    found = stored(near_links(distinct.select("node", "n", "embedding"), dims, threshold))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    labelled = label_groups(distinct.select(F.col("node").alias("id"), "node", F.col("first").alias("doc_id")), found.where("b is not null").select("a", "b"))
    known = stored(distinct.select("node", "embedding", "n").join(labelled, "node").join(counts, "node", "left").select("embedding", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    linked = good.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
