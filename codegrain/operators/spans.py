"""Byte ranges of texts: where patterns lie, the union of ranges that nest or overlap, texts without them, and ranges inside
others.

Pairs of a range and those inside it are found in one sweep over ranges by their start, with those that are still open on a
list, instead of a comparison of all ranges of a text. Rows are dealt by text and start, so a text with very many ranges is
swept by several tasks; a range that is open where another task's part begins is sent there, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegrain.sources.shared import scratch


def found(files: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, name, start_byte, end_byte): where each of the named patterns lies in each text, found one by one from the left.

    A text is parted at its matches; lengths of parts and matches add up to offsets. Patterns are Java's and match no empty
    text; a null text has none. key is unique.
    """
    every = None
    for name, pattern in patterns.items():
        cut = files.select(key, F.arrays_zip(F.split(text, pattern, -1).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")).alias("z"))
        each = cut.select(key, F.posexplode("z").alias("nth", "z")).select(key, "nth", F.octet_length("z.part").alias("n"), F.octet_length("z.hit").alias("m"))
        before = F.sum(F.col("n") + F.coalesce("m", F.lit(0))).over(Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
        start = F.coalesce(before, F.lit(0)) + F.col("n")
        of = each.select(key, F.lit(name).alias("name"), start.cast("long").alias("start_byte"), (start + F.col("m")).cast("long").alias("end_byte")).where("end_byte is not null")
        every = of if every is None else every.unionByName(of)
    return every


def union(ranges: DataFrame, key: str) -> DataFrame:
    """(key, start_byte, end_byte): the ranges (key, start_byte, end_byte) of each text as few that neither overlap nor touch.
    Empty and reversed ranges and those with a null are none."""
    sound = ranges.where("start_byte < end_byte").select(key, "start_byte", "end_byte").distinct()
    order = Window.partitionBy(key).orderBy("start_byte", "end_byte")
    reached = F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = sound.withColumn("_new", F.when(F.coalesce(F.col("start_byte") > reached, F.lit(True)), 1).otherwise(0))
    island = begun.withColumn("_island", F.sum("_new").over(order))
    return island.groupBy(key, "_island").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")).drop("_island")


def _border(raw, at):
    """An offset inside a character moves back to where the character begins."""
    inside = lambda i: F.hex(F.substring(raw, i + 1, F.lit(1))).between("80", "BF")
    return F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)


def without(files: DataFrame, ranges: DataFrame, key: str, text: str) -> DataFrame:
    """files with the bytes of the ranges (key, start_byte, end_byte) gone from their text; ranges may nest, overlap, come twice
    and go beyond the text. Texts without ranges and null ones stay as they are, other columns too; key is unique."""
    merged = union(ranges.withColumn("start_byte", F.when(F.col("start_byte") < 0, 0).otherwise(F.col("start_byte"))), key)
    listed = merged.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte"))).alias("_cuts"))  # of one text
    raw = F.encode(text, "UTF-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda c: F.least(c["end_byte"], F.octet_length(text).cast("long"))))
    starts = F.concat(F.transform("_cuts", lambda c: F.least(c["start_byte"], F.octet_length(text).cast("long"))), F.array(F.octet_length(text).cast("long")))
    piece = lambda a, b: F.decode(F.substring(raw, (_border(raw, a) + 1).cast("int"), (_border(raw, b) - _border(raw, a)).cast("int")), "UTF-8")
    left = F.array_join(F.zip_with(ends, starts, piece), "")
    joined = files.join(listed, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(text, F.when(F.col("_cuts").isNull() | F.col(text).isNull(), F.col(text)).otherwise(left)).select(files.columns)


def inside(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """(key, outer_id, inner_id, start_byte, end_byte): for the ranges outer (key, id, start_byte, end_byte) the ranges inner
    (the same columns) of the same text that lie within them, borders included; a range lies within its equal.

    ids are numbers that tell rows of a side apart; rows with a null key, start or end lie nowhere. The result has a row for
    each pair, so chosen ranges and not all of them should be asked for where nesting is deep.
    """
    spark = outer.sparkSession
    columns = lambda df, asks: df.where("start_byte <= end_byte").select(F.col(key).alias("k"), F.col("id").cast("long").alias("id"), F.col("start_byte").cast("long").alias("s"), F.col("end_byte").cast("long").alias("e"), F.lit(asks).alias("asks"))
    both = columns(outer, True).unionByName(columns(inner, False)).where("k is not null")
    path = scratch(spark)
    both.repartitionByRange("k", "s").withColumn("part", F.spark_partition_id()).write.parquet(path)
    laid = spark.read.schema(f"k {both.schema['k'].dataType.simpleString()}, id long, s long, e long, asks boolean, part int").parquet(path)
    # where each part begins: a row for each; a text that spans parts has its open ranges sent on
    bounds = laid.groupBy("k", "part").agg(F.min("s").alias("begins"))
    several = bounds.withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n > 1").drop("n")
    later = several.select(F.col("k").alias("k2"), F.col("part").alias("to"), "begins")
    carried = laid.where("asks").join(F.broadcast(later), (F.col("k") == F.col("k2")) & (F.col("to") > F.col("part")) & (F.col("begins") <= F.col("e")))
    dealt = laid.unionByName(carried.select("k", "id", "s", "e", "asks", F.col("to").alias("part")))
    kind = both.schema["k"].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, out = None, [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], names[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["k", "outer_id", "inner_id", "start_byte", "end_byte"])

        names = [None]
        for batch in batches:
            names[0] = batch.schema.field(0).type
            for k, i, s, e, asks, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, part) != at:
                    at, open_ = (k, part), []
                if asks:
                    open_.append((e, i))
                    continue
                open_ = [o for o in open_ if o[0] >= s]
                out.extend((k, o, i, s, e) for end, o in open_ if end >= e)
                if len(out) >= 10_000:
                    yield flush()
        if out:
            yield flush()

    # of equal starts the asking ranges come first; which of them is longer does not matter
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = dealt.repartition(parts, "k", "part").sortWithinPartitions("k", "part", "s", F.desc("asks"))
    pairs = placed.select("k", "id", "s", "e", "asks", "part").mapInArrow(sweep, f"k {kind}, outer_id long, inner_id long, start_byte long, end_byte long")
    return pairs.withColumnRenamed("k", key)
