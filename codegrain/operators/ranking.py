"""Ranks within groups of any size, and the closest vectors of a query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.sources.shared import scratch


def ranked_in(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with row_number() of each group by order (which should leave no ties), without a task that gets a whole group.

    Rows are dealt by ranges of group and order; a window numbers a group within each range, and what a group has in
    earlier ranges is added. Only groups that span ranges need that, so there are at most two rows of it for each range.
    """
    spark = df.sparkSession
    keys = [*map(F.col, group), *order]
    path = scratch(spark)
    laid = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    laid.write.parquet(path)
    laid = spark.read.schema(laid.schema).parquet(path)
    sizes = laid.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    several = sizes.withColumn("_ranges", F.count("*").over(Window.partitionBy(*group))).where("_ranges > 1")
    before = several.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_range").alias("_at"), "_before")
    same = F.col("_range") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    out = laid.withColumn(name, within).join(F.broadcast(before), same, "left")
    return out.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, name)


def _matrix(column: pa.ListArray) -> np.ndarray:
    width = int(column.value_lengths()[0].as_py())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def closest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 16_384) -> DataFrame:
    """(query_id, vec_id, cosine): for queries (query_id, embedding) the k closest other vectors (vec_id, embedding), by
    cosine to nine decimals and then by vec_id. All vectors have the same number of components; zero vectors, null ones and
    those with a null are close to nothing.

    Both sides are dealt to blocks; a task multiplies a block of queries by a block of vectors and keeps k of each query,
    and a window takes the best of those. Products by matrix only choose; what they choose is computed pair by pair, so
    equal vectors have equal cosines.
    """
    sound = lambda df: df.where("exists(embedding, x -> x <> 0) and not exists(embedding, x -> x is null or isnan(x))")
    queries, vectors = sound(queries.select("query_id", "embedding")), sound(vectors.select("vec_id", "embedding"))
    n_queries, n_vectors = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    spread = max(n_vectors, min(32, vectors.sparkSession.sparkContext.defaultParallelism))  # work for all tasks of a small table
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(mine("query_id", n_queries).alias("q"), every(spread).alias("v"), F.col("query_id").alias("id"), F.lit(True).alias("asks"), "embedding")
    held = vectors.select(every(n_queries).alias("q"), mine("vec_id", spread).alias("v"), F.col("vec_id").alias("id"), F.lit(False).alias("asks"), "embedding")
    cells = asked.unionByName(held).select((F.col("q") * spread + F.col("v")).alias("cell"), "id", "asks", "embedding")

    def best(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        asks = rows.column("asks").to_numpy()
        if asks.all() or not asks.any():
            return
        x = np.concatenate([_matrix(c) for c in rows.column("embedding").chunks])
        ids, size = rows.column("id").to_numpy(), np.linalg.norm(x, axis=1)
        unit = (x / size[:, None]).astype(np.float32)
        theirs = np.flatnonzero(~asks)
        for at in range(0, int(asks.sum()), 512):
            some = np.flatnonzero(asks)[at : at + 512]
            near = unit[some] @ unit[theirs].T
            near[ids[some][:, None] == ids[theirs]] = -2
            most = min(k, near.shape[1])
            bar = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
            q, v = np.nonzero((near >= bar[:, None] - 1e-4) & (near > -2))
            q, v = some[q], theirs[v]
            exact = np.round(np.einsum("ij,ij->i", x[q], x[v]) / (size[q] * size[v]), 9)
            order = np.lexsort((ids[v], -exact, ids[q]))
            q, v, exact = q[order], v[order], exact[order]
            begins = np.flatnonzero(np.r_[True, ids[q][1:] != ids[q][:-1]]) if len(q) else np.zeros(0, np.int64)
            keep = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)])) < k
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(ids[v[keep]]), pa.array(exact[keep])], names=["query_id", "vec_id", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, kept = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if kept and keys[begin] != cell:
                    yield from best(pa.Table.from_batches(kept))
                    kept = []
                cell = keys[begin]
                kept.append(batch.slice(begin, end - begin))
        if kept:
            yield from best(pa.Table.from_batches(kept))

    n_cells = n_queries * spread
    parts = min(n_cells, 8192)
    found = cells.repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell").mapInArrow(run, "query_id long, vec_id long, cosine double")
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("_rank", top).where(F.col("_rank") <= k).drop("_rank")
