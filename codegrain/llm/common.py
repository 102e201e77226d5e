"""What the operators of this package share: tables, stored tables, free column names, rows of their own."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.sources.shared import discard, scratch

#: ASCII white space, the only characters that part words here.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Rows that Python gets at once while texts are read; Spark's default of 10,000 whole texts is tens of MB, several times.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession):
    """While a table is written here, Python gets at most BATCH_ROWS rows at once; the session's setting comes back."""
    before = spark.conf.get(_ROWS)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


class Stored:
    """Tables of one computation; drop() deletes those that are no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark)
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def held(self, df: DataFrame) -> DataFrame:
        """df kept on the executors' disks, for what a few steps use and then drop: no files are made, lineage stays, and what
        a lost executor held is computed again from the stored tables before it."""
        out = df.persist(StorageLevel.DISK_ONLY)
        self.paths[id(out)] = (out, None)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self.paths:
                out, path = self.paths.pop(id(df))
                if path is None:
                    out.unpersist()
                else:
                    discard(self.spark, path)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends, nothing is computed twice, lost executors don't matter."""
    return Stored(df.sparkSession)(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def remainder(col, n: int):
    """crc32 of an id as text, modulo n: how rows are split into folds."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """64 bits from all columns that can be hashed: tells rows with the same doc_id apart, equal rows not."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)))
