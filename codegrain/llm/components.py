"""Connected components by hooking and contraction, on tables in the shared folder, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import Stored, fresh, row_hash, stored


def _roots(parents: DataFrame, keep: Stored) -> DataFrame:
    """(id, parent) with parent < id, followed to the roots by pointer doubling."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        jumped = keep(parents.join(up, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
        if jumped.where("moved").isEmpty():
            return jumped.select("id", "parent")
        parents = jumped.select("id", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a long, b long): the smallest id reachable.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their roots and contracts the
    edges to what still joins different roots. Minima and distinct rows are combined before they are shuffled, so a
    node with very many edges costs no task more than another. Null ends and loops are dropped; no edges, no rows.
    """
    keep = Stored(edges.sparkSession)
    edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        roots = _roots(keep(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))), keep)
        first = roots.select(F.col("id").alias("a"), F.col("parent").alias("ra"))
        second = roots.select(F.col("id").alias("b"), F.col("parent").alias("rb"))
        labels = roots if labels is None else keep(_relabelled(labels, roots))
        a, b = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        joined = edges.join(first, "a", "left").join(second, "b", "left").select(a.alias("x"), b.alias("y")).where("x <> y")
        left = keep(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        keep.drop(edges)
        edges = left
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    own = labels.select(F.col("parent").alias("id")).distinct().join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return labels.select("id", F.col("parent").alias("component")).unionByName(own)


def _relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Labels so far carried on to the new roots, and the nodes that got their first label now."""
    step = roots.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
    old = labels.join(step, "parent", "left").select("id", F.coalesce("root", "parent").alias("parent"))
    return old.unionByName(roots.join(labels.select("id"), "id", "left_anti").select("id", "parent"))


def numbered(prints: DataFrame) -> DataFrame:
    """(id, node, doc_id, row) for prints (doc_id, row, node): each node once, with its first row by doc_id, nulls last,
    and then by row. ids rise in the order of these rows, so the smallest id of a group is that of its first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = prints.groupBy("node").agg(first.alias("first"))
    ordered = nodes.repartitionByRange("first", "node").sortWithinPartitions("first", "node")
    return stored(ordered.select(F.monotonically_increasing_id().alias("id"), "node", "first.doc_id", "first.row"))


def label_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, node, component_id, first) for numbered nodes and edges (a, b) between their ids, stored.

    component_id is the doc_id of the first row reachable, first says that the node is the one that holds it. Ids are in
    the order of rows, so the root of a group is the answer, and nothing is grouped by it.
    """
    found = stored(components(edges).where("id <> component"))
    named = nodes.select("id", "node", "doc_id").join(found, "id", "left")
    alone = named.where("component is null").select("id", "node", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    roots = nodes.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id"))
    joined = named.where("component is not null").join(roots, "component").select("id", "node", "component_id", F.lit(False).alias("first"))
    return stored(alone.unionByName(joined))


def first_of_groups(docs: DataFrame, prints: DataFrame, nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """The documents, one of each group: its first row by doc_id, nulls last, and then by a hash of the whole row. prints has
    (doc_id, row) of every row.

    All columns are as they were. Rows that are equal in every column are one document, of which one stays.
    """
    key, row = fresh(docs, "kept_key", "kept_row")
    named = (F.col("doc_id").alias(key), F.col("row").alias(row))
    stay = nodes.join(labelled.where("first").select("id"), "id", "left_semi").select(*named)
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), row: row_hash(docs)})
    same = lambda left, right: left[key].eqNullSafe(right[key]) & (left[row] == right[row])
    kept = marked.join(stay, same(marked, stay), "left_semi")
    repeated = prints.groupBy("doc_id", "row").count().where("count > 1").select(*named)
    again = stored(repeated.join(stay, same(repeated, stay), "left_semi"))
    if again.isEmpty():
        return kept.drop(key, row)
    # map columns cannot be compared, so rows are told apart by key and row; equal ones are combined before the shuffle
    once = kept.join(again, same(kept, again), "left_semi").dropDuplicates([key, row])
    return kept.join(again, same(kept, again), "left_anti").unionByName(once).drop(key, row)
