"""Hard negatives by product quantisation with rigorous bounds.

A vector is cut into parts of a few components; each part becomes the number of the nearest of 256 centres that were fitted on
a bounded sample, and the norm of what the centres leave of the vector is stored with the codes. For an anchor a table holds
its product with every centre, so a row's approximate score is a sum of looked-up numbers, and by Cauchy-Schwarz the true score
lies no further from it than the anchor's norm times the row's stored norm. Rows whose interval cannot reach a place among the
best are left out; those that may are scored in integers, which alone decide.

Anchors and rows are dealt to blocks and each pair of blocks is one group of a shuffle. Two passes: the first finds the best rows
of an anchor's own label, its positives; the second the best rows of other labels whose score lies in the window of each
positive. A block hands on no more than the asked number for each anchor or window; a rank over these, of which Spark keeps no
more before it shuffles, gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.llm.common import stored

#: Components of a part, and centres of a part.
PART, CENTRES = 2, 256
#: Vectors on which centres are fitted, and passes of fitting; poor centres cost time, never a result.
FIT_ROWS, FIT_PASSES = 8_192, 6
#: Scaled components beyond this count as this; sums of products then fit 64 bits.
MOST = 1 << 24
#: Share of an interval by which floating-point sums may be off.
SLACK = 1e-9
#: Rows of a block that are looked at together, and anchors.
TILE_ROWS, TILE_ANCHORS = 4096, 128
#: Pairs that are scored exactly at once; with very many equal vectors all of them are candidates.
RERANKED = 65_536


def scaled(column: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale x) of each component in double precision; shorter vectors are padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(np.floor(scale * flat), -MOST, MOST)
    return out


def fit(x: np.ndarray) -> np.ndarray:
    """Centres (part, centre, component) of the rows of x, by Lloyd's passes from spread rows."""
    parts = x.shape[1] // PART
    out = np.zeros((parts, CENTRES, PART))
    if not len(x):
        return out
    for p in range(parts):
        y = x[:, p * PART : (p + 1) * PART].astype(np.float64)
        centres = y[np.linspace(0, len(y) - 1, CENTRES).astype(int)]
        for _ in range(FIT_PASSES):
            near = nearest(y, centres)
            n = np.bincount(near, minlength=CENTRES)
            sums = np.stack([np.bincount(near, y[:, i], CENTRES) for i in range(PART)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        out[p] = centres
    return out


def nearest(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(axis=1)
    return np.concatenate([(size - 2 * (y[at : at + 8192] @ centres.T)).argmin(axis=1) for at in range(0, len(y), 8192)] or [np.zeros(0, np.int64)])


def quantised(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of what they leave)."""
    codes = np.zeros((len(x), len(centres)), np.uint8)
    left = np.zeros(len(x))
    for p, c in enumerate(centres):
        y = x[:, p * PART : (p + 1) * PART].astype(np.float64)
        codes[:, p] = nearest(y, c)
        left += ((y - c[codes[:, p]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left) * (1 + SLACK)


def tables(anchors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(part, centre, anchor): products of the anchors' parts with the centres."""
    return np.stack([c @ anchors[:, p * PART : (p + 1) * PART].astype(np.float64).T for p, c in enumerate(centres)])


def looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(row, anchor): approximate scores."""
    out = table[0][codes[:, 0]]
    for p in range(1, len(table)):
        out += table[p][codes[:, p]]
    return out


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, -inf where there are fewer rows."""
    return np.full(values.shape[1], -np.inf) if len(values) < k else np.partition(values, len(values) - k, axis=0)[len(values) - k]


def best_in(low: np.ndarray, high: np.ndarray, ok: np.ndarray, k: int, bottom: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Which rows (first axis) may be among the k best of a window bottom..top of each column, by their intervals low..high.
    At least k rows that are sure to lie in the window bar those that cannot reach the worst of them."""
    sure = np.where(ok & (low >= bottom) & (high <= top), low, -np.inf)
    return ok & (high >= np.maximum(bottom, _largest(sure, k))) & (low <= top)


class Block:
    """Rows of one side: identifiers, label, integer vector, codes and residual norm."""

    def __init__(self, t: pa.Table, dims: int):
        t = t.combine_chunks()
        get = lambda name: t.column(name).to_numpy()
        self.row, self.vec_id, self.label, self.left = get("row"), get("vec_id"), get("label"), get("residual")
        flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in t.column(name).chunks])
        self.x = flat("x").astype(np.int64).reshape(len(self.row), dims)
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(self.row), -1)


def _ranked(score: np.ndarray, vec_id: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by falling score and rising vec_id."""
    order = np.lexsort((vec_id, -score, group))
    begins = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[nth < k]


def found(anchors: Block, rows: Block, centres: np.ndarray, same: bool, k: int, windows: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(window or anchor, row, score) of the k best rows of each anchor's own label (same), or for each window (anchor's place,
    lowest and highest score) of other labels."""
    size = np.sqrt((anchors.x.astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
    if windows is None:
        windows = (np.arange(len(anchors.row)), np.full(len(anchors.row), -np.inf), np.full(len(anchors.row), np.inf))
    place, bottom, top = windows
    for at in range(0, len(place), TILE_ANCHORS):
        mine = np.arange(at, min(at + TILE_ANCHORS, len(place)))
        of, which = np.unique(place[mine], return_inverse=True)
        table = tables(anchors.x[of], centres)
        held, bar = (np.zeros(0, np.int64),) * 3, np.full(len(mine), -np.inf)
        for start in range(0, len(rows.row), TILE_ROWS):
            part = slice(start, start + TILE_ROWS)
            near, off = looked_up(table, rows.codes[part]), rows.left[part][:, None] * size[of]
            off = off + SLACK * (np.abs(near) + off)
            ok = (rows.label[part][:, None] == anchors.label[of]) == same
            ok &= rows.row[part][:, None] != anchors.row[of]
            low, high = near - off, near + off
            if len(of) < len(mine):  # several windows of an anchor
                low, high, ok = low[:, which], high[:, which], ok[:, which]
            r, w = np.nonzero(best_in(low, high, ok & (high >= bar), k, bottom[mine], top[mine]))
            for i in range(0, len(r), RERANKED):
                some, to = start + r[i : i + RERANKED], mine[w[i : i + RERANKED]]
                score = np.einsum("ij,ij->i", rows.x[some], anchors.x[place[to]])
                inside = (score >= bottom[to]) & (score <= top[to])
                every = tuple(np.concatenate(c) for c in zip(held, (to[inside], some[inside], score[inside]), strict=True))
                keep = _ranked(every[2], rows.vec_id[every[1]], every[0], k)
                held = tuple(c[keep] for c in every)
            # what comes later must reach the last of k rows that are there
            bar = np.where(np.bincount(held[0] - at, minlength=len(mine)) == k, np.inf, -np.inf)
            np.minimum.at(bar, held[0] - at, np.where(bar[held[0] - at] > 0, held[2], -np.inf))
        yield held


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal first column, which come side by side, as tables."""
    key, kept = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            if kept and keys[begin] != key:
                yield pa.Table.from_batches(kept)
                kept = []
            key = keys[begin]
            kept.append(batch.slice(begin, end - begin))
    if kept:
        yield pa.Table.from_batches(kept)


def indexed(vectors: DataFrame, scale: int = 256) -> tuple[DataFrame, int, np.ndarray]:
    """(row, vec_id, label, x, codes, residual) of the rows that take part, stored, the components of x, and the centres.

    Rows without vec_id, label or vector and those with a null or non-finite component take no part; an empty vector is one of
    zeros. Every row is a row of its own, whatever vec_id it has.
    """
    kind = vectors.schema["embedding"].dataType
    as_is = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    vector = F.col("embedding") if as_is else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("embedding"))
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    n, widest = good.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dims = max(1, -(-(widest or 0) // PART)) * PART
    share = int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 30))
    drawn = good.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < share).select("embedding").toArrow()  # about FIT_ROWS vectors
    centres = fit(np.concatenate([np.zeros((0, dims), np.int64), *(scaled(c, dims, scale) for c in drawn.column(0).chunks)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch.column(3), dims, scale)
            codes, left = quantised(x, centres)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dims, pa.int32()), pa.array(x.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left, pa.float64())], names=["row", "vec_id", "label", "x", "codes", "residual"])

    numbered = good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding")
    return stored(numbered.mapInArrow(run, "row long, vec_id long, label long, x array<int>, codes binary, residual double")), dims, centres


def _cells(asked: DataFrame, held: DataFrame, n_asked: int, n_held: int, block: int) -> tuple[DataFrame, int]:
    """Both sides dealt to pairs of blocks, and how many pairs there are."""
    blocks, spread = max(1, -(-n_asked // block)), max(1, -(-n_held // block), min(32, asked.sparkSession.sparkContext.defaultParallelism))
    mine = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(mine(blocks).alias("a"), every(spread).alias("b"), F.lit(True).alias("asks"), "*")
    right = held.select(every(blocks).alias("a"), mine(spread).alias("b"), F.lit(False).alias("asks"), "*")
    both = left.unionByName(right, allowMissingColumns=True).select((F.col("a").cast("long") * spread + F.col("b")).alias("cell"), F.col("*")).drop("a", "b")
    parts = min(blocks * spread, 8192)
    return both.repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell"), blocks * spread


def mined(vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, block: int = 16_384) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Scores are integer inner products of the components times scale, rounded down; higher ones come first, of equal ones the
    smaller vec_id. Anchors are the rows for which the condition `anchor` holds; their positives the first rows of the same label
    other than themselves; negatives the first rows of other labels with a score of window[0] to window[1] hundredths of the
    positive's, ranked from 1. An anchor without positives, or a positive without negatives, gives no row. Rows that share a
    vec_id, equal or not, are anchors, positives and negatives of their own. indexed() says which rows take part; other
    columns are ignored; no rows, no result.
    """
    index, dims, centres = indexed(vectors, scale)
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(centres)  # of fixed size for the components
    anchors = index.where(anchor)
    n_rows, n_anchors = index.agg(F.count("*"), F.count_if(F.expr(anchor))).first()

    def sides(t: pa.Table) -> tuple[pa.Table, Block] | None:
        asks = t.column("asks")
        ours, theirs = t.filter(asks), t.filter(pa.compute.invert(asks))
        return (ours, Block(theirs, dims)) if ours.num_rows and theirs.num_rows else None

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            if pair := sides(t):
                ours, theirs = Block(pair[0], dims), pair[1]
                for a, r, score in found(ours, theirs, sent.value, True, positives, None):
                    yield pa.RecordBatch.from_arrays([pa.array(ours.row[a]), pa.array(theirs.row[r]), pa.array(theirs.vec_id[r]), pa.array(score)], names=["row", "positive_row", "positive_id", "positive_score"])

    def top(df: DataFrame, keys: list[str], score: str, by: str, k: int, name: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), by, f"{by.removesuffix('_id')}_row")
        return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)

    cells, _ = _cells(anchors, index, n_anchors, n_rows, block)
    chosen = stored(top(cells.mapInArrow(own, "row long, positive_row long, positive_id long, positive_score long"), ["row"], "positive_score", "positive_id", positives, "nth").drop("nth"))

    low, high = window
    bounds = chosen.groupBy("row").agg(F.collect_list(F.struct("positive_row", "positive_id", "positive_score")).alias("positives"))  # a few for each
    asked = anchors.join(bounds, "row")
    cells, _ = _cells(asked, index, n_anchors, n_rows, block)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            if not (pair := sides(t)):
                continue
            ours, theirs = Block(pair[0], dims), pair[1]
            lists = pair[0].column("positives").combine_chunks()
            flat = lists.flatten()
            place = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            row, vec_id, score = (flat.field(i).to_numpy() for i in range(3))
            # 100 s >= low p and 100 s <= high p, in integers
            bottom, ceiling = -(-low * score // 100), high * score // 100
            for w, r, s in found(ours, theirs, sent.value, False, negatives, (place, bottom, ceiling)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ours.row[place[w]], ours.vec_id[place[w]], row[w], vec_id[w], score[w], theirs.row[r], theirs.vec_id[r], s)], names=["row", "anchor_id", "positive_row", "positive_id", "positive_score", "negative_row", "negative_id", "negative_score"])

    schema = "row long, anchor_id long, positive_row long, positive_id long, positive_score long, negative_row long, negative_id long, negative_score long"
    ranked = top(cells.mapInArrow(others, schema), ["row", "positive_row"], "negative_score", "negative_id", negatives, "rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
