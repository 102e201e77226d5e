"""A budget of failures that stops a running stream.

Failures are counted by an observation while a batch is written, and a listener adds them up. When they have used up the budget it
stops the query, so at most the batch that runs at that moment follows. Batches are written one by one under their number; those
beyond the one that used up the budget don't count and aren't returned.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Spent:
    """What a run came to: rows and failures of the batches that count, the last of them, and whether the budget ended it."""

    rows: int = 0
    failed: int = 0
    batch: int = -1
    over: bool = False
    by_batch: dict[int, tuple[int, int]] = field(default_factory=dict)


class Budget(StreamingQueryListener):
    def __init__(self, spark: SparkSession, name: str, most: int):
        self.spark, self.name, self.most = spark, name, most
        self.spent, self.ended = Spent(), threading.Event()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is None or progress.batchId in self.spent.by_batch:
            return
        self.spent.by_batch[progress.batchId] = (seen["n"], seen["failed"])
        if self.spent.over:
            return
        self.spent.rows += seen["n"]
        self.spent.failed += seen["failed"]
        self.spent.batch = progress.batchId
        if self.spent.failed >= self.most:
            self.spent.over = True
            query = self.spark.streams.get(str(progress.id))
            if query is not None:
                threading.Thread(target=query.stop, daemon=True).start()  # a listener must not wait for its own query

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def run_within(rows: DataFrame, failed: Column, most: int, out: str, checkpoint: str) -> tuple[DataFrame, Spent]:
    """Writes a stream of rows that is there (all its files, batch by batch) to out until it ends or `most` of them have failed.

    Returns (the rows of the batches that count, with their `batch`, what was spent). A batch that is written again after a
    failure replaces what it had written.
    """
    spark = rows.sparkSession
    name = f"budget_{uuid.uuid4().hex}"
    listener = Budget(spark, name, most)
    spark.streams.addListener(listener)

    def write(batch: DataFrame, number: int) -> None:
        if not listener.spent.over:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted = rows.observe(name, F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    try:
        query = counted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    schema = rows.schema.add("batch", "long")
    every = spark.read.schema(schema).option("basePath", out).parquet(*[f"{out}/batch={b}" for b in sorted(listener.spent.by_batch) if b <= listener.spent.batch]) if listener.spent.batch >= 0 else spark.createDataFrame([], schema)
    return every, listener.spent
