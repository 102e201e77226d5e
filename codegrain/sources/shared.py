"""Folders for intermediate files that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="codegrain-")


def _home(spark: SparkSession) -> str:
    """Where all of this application's folders are.

    The base is spark.checkpoint.dir. Without it a session that runs in one process uses a temporary folder; a cluster,
    whose executors could not read that, is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/codegrain-{sc.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new folder, to be made by what is written there."""
    return f"{_home(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to a folder of scratch() and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch() with all its files, wherever Spark keeps it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder of scratch(); the folder above the target is made."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place(target).getParent())
    if not files.rename(place(source), place(target)):
        raise OSError(f"{source} could not be moved to {target}")


def cleanup(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; for when its results have been consumed."""
    discard(spark, _home(spark))
