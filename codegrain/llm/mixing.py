"""Mixing sources to target weights by repeating and dropping whole documents. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.llm.common import WORD, fresh, stored

#: Sources up to this many (some 100 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for (source, source_size).

    Sources by code point, null last, have the weights in turn. The targets are what a level L gives: each source L
    times its weight, but no more than `most` times its size, L such that they add up to share of all sizes. That is
    where handing the excess of full sources to the others by weight ends. Sources fill up in the order of size over
    weight, so L follows from running sums in that order. The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    # the level as if all sources below were full and no other: it rises while the next source fills up at it and
    # falls from then on, so the highest is the one sought
    held = ranked.withColumn("level", level)
    fixed = held.withColumn("level", F.max("level").over(all_rows))
    return fixed.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def uniform(*keys: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """documents (doc_id, text, source) with their other columns, and size, source_size, target, copies.

    copies: how often the mix takes the document: the whole part of target / source_size, and once more with the
    fraction as probability, drawn from a hash of doc_id, source and seed; reruns agree. size is the number of words, 0
    for null or empty text; such rows are taken like others and add no words; a source without words has target 0 and
    its documents are not taken. Null sources are one source, the last. Rows with the same doc_id and source share
    their draw. Input columns with these names are replaced. `most` must be at least `share`.
    """
    if most < share:
        raise ValueError("targets cannot reach the share")
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.withColumn("size", n_words(F.col("text").cast("string")))
    goal = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    key, size, target = fresh(sized, "mix_source", "source_size", "target")
    goal = goal.select(F.col("source").alias(key), F.col("source_size").alias(size), F.col("target").alias(target))
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    rate = F.coalesce(F.try_divide(F.col(target), F.col(size).cast("double")), F.lit(0.0))
    extra = (uniform(F.col("doc_id"), F.col("source"), seed=seed) < rate - F.floor(rate)).cast("long")
    return sized.join(goal, F.col("source").eqNullSafe(F.col(key))).withColumn("copies", F.floor(rate) + extra).drop(key)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of documents, whatever their names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    planned = mix_plan(docs.select("doc_id", "text", "source", row), **options)
    wanted = planned.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return wanted.select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         ([5.0::DOUBLE, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sizes
), held AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
  FROM ranked WINDOW below AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fixed AS (
  SELECT *, max(level) OVER () AS found FROM held
), goal AS (
  SELECT source, source_size, least(cap, found * weight) AS target FROM fixed
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         coalesce(g.target / nullif(g.source_size::DOUBLE, 0), 0) AS rate,
         ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, '') || ':' || coalesce(s.source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
