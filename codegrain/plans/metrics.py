"""What a run did: rows and failures counted as they pass, and how many each worker made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(answers: DataFrame, name: str = "answers") -> tuple[DataFrame, Observation]:
    """(the same rows, their counts): n, failed (rows with an error) and empty (rows without an answer or an error). The counts
    come with the action that uses the rows; nothing is computed twice."""
    seen = Observation(name)
    failed = F.col("error").isNotNull()
    empty = ~failed & (F.length(F.coalesce("answer", F.lit(""))) == 0)
    return answers.observe(seen, F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.count_if(empty).alias("empty")), seen


def within_budget(answers: DataFrame, most_failed: int = 100) -> bool:
    """Whether no more than so many rows failed: what a caller asks before it pays for another round."""
    return answers.where("error is not null").limit(most_failed + 1).count() <= most_failed


def by_worker(rows: DataFrame) -> DataFrame:
    """(worker, n): the rows that each task made, in order."""
    return rows.groupBy(F.spark_partition_id().alias("worker")).agg(F.count("*").alias("n")).orderBy("worker")
