"""Scoring as answers arrive: the batch plan over a file stream, with a checkpoint instead of rewritten results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def score_available(rows: DataFrame, plan, out: str, checkpoint: str) -> StreamingQuery:
    """Runs plan over what has arrived since the last run and appends to out; a run that is repeated after a failure
    writes nothing twice."""
    return plan(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
