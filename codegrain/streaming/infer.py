"""Inference as a stream that survives a stop: each sample is asked until it is answered, failed calls come back by timer, answers are written once.

A sample that comes again is dropped. Samples are dealt to GROUPS keys by a hash; the state of a key is what its samples that wait
for another try ask and how often they were tried, in parts of PART samples under the time at which they are due. A call that fails
puts its sample there; one timer for each key and time asks again, later each time, until a call answers or the tries are used up.
So a batch costs calls of the state by keys and parts, not by samples, and touches only samples that are new or due. The
checkpoint holds states and timers, the sink's log what was written: a query that was stopped or killed goes on where it was,
and a batch that was cut off is asked again but its answers are written once.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codegrain.functions.text import after_thinking

#: client(messages, model, attempt) -> text
Client = Callable[[list[dict], str, int], str]
ANSWERS = "sample_id string, model string, answer string, error string, tries int"
#: Keys of the state, and samples that one value of it holds at most.
GROUPS, PART = 512, 500


def asked(client: Client, messages: list[dict], model: str, attempt: int, seconds: float | None, pool: ThreadPoolExecutor | None = None) -> tuple[str, str | None]:
    """(answer, error) of one call, which may take so many seconds; a call beyond them is left behind and counts as failed.
    A pool given is for calls one after the other and is shut down if one is left behind."""
    own = pool or ThreadPoolExecutor(1)
    call = own.submit(client, messages, model, attempt)
    try:
        return call.result(seconds), None
    except Exception as e:  # the row says what failed
        if isinstance(e, TimeoutError) and not call.done():
            own.shutdown(wait=False)
            return "", f"TimeoutError: no answer within {seconds:g} s"
        return "", f"{type(e).__name__}: {e}"
    finally:
        if pool is None:
            own.shutdown(wait=False)


class Samples(StatefulProcessor):
    """Keys are (part,), whose rows are (part, sample_id, model, messages)."""

    def __init__(self, client: Client, tries: int, wait_ms: int, seconds: float | None):
        self.client, self.tries, self.wait_ms, self.seconds = client, tries, wait_ms, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due long, n int", "samples string")

    def _ask(self, samples: Iterator[tuple[str, str, str, int]], now_ms: int) -> Iterator[pd.DataFrame]:
        """Answers of (sample_id, model, messages, tried); those that failed wait for another try."""
        import json

        pool, rows, again, placed = ThreadPoolExecutor(1), [], {}, {}
        for sample_id, model, messages, tried in samples:
            answer, error = asked(self.client, json.loads(messages), model, tried, self.seconds, pool)
            if pool._shutdown:
                pool = ThreadPoolExecutor(1)
            tried += 1
            if error is not None and tried < self.tries:
                due = now_ms + self.wait_ms * 2 ** (tried - 1)
                again.setdefault(due, []).append((sample_id, model, messages, tried))
                if len(again[due]) == PART:
                    self._wait(due, again.pop(due), placed)
                continue
            rows.append((sample_id, model, answer, error, tried))
            if len(rows) == PART:
                yield self._frame(rows)
                rows = []
        pool.shutdown(wait=False)
        for due, some in again.items():
            self._wait(due, some, placed)
        if rows:
            yield self._frame(rows)

    def _wait(self, due: int, samples: list, placed: dict[int, int]) -> None:
        """Puts samples into the first free part under the time; placed says from where to look."""
        import json

        n = placed.get(due, 0)
        while self.waiting.containsKey((due, n)):
            n += 1
        placed[due] = n + 1
        self.waiting.updateValue((due, n), (json.dumps(samples),))
        self.handle.registerTimer(due)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["sample_id", "model", "answer", "error", "tries"])

    def _due(self, due: int) -> Iterator[tuple[str, str, str, int]]:
        import json

        n = 0
        while self.waiting.containsKey((due, n)):
            samples = json.loads(self.waiting.getValue((due, n))[0])
            self.waiting.removeKey((due, n))
            n += 1
            yield from samples

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        samples = ((*row, 0) for frame in rows for row in frame[["sample_id", "model", "messages"]].itertuples(index=False, name=None))
        yield from self._ask(samples, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ask(self._due(expiredTimerInfo.getExpiryTimeInMs()), timerValues.getCurrentProcessingTimeInMs())


def start(tasks: DataFrame, client: Client, out: str, checkpoint: str, tries: int = 3, wait_ms: int = 1000, seconds: float | None = 60, every: str = "1 second") -> StreamingQuery:
    """Starts answering a stream of tasks (sample_id, model, messages array<struct<role, content>>); out gets ANSWERS, a row for
    each sample and model when it is answered or has failed `tries` times. How many files a batch takes says how much is asked
    again after a kill (maxFilesPerTrigger). The session needs the RocksDB state store, see session()."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process beside the driver gets no shipped files
    part = F.pmod(F.xxhash64("sample_id", "model"), F.lit(GROUPS)).cast("int").alias("part")
    keyed = tasks.select(part, "sample_id", "model", F.to_json("messages").alias("messages")).dropDuplicates(["sample_id", "model"])
    answers = keyed.groupBy("part").transformWithStateInPandas(Samples(client, tries, wait_ms, seconds), outputStructType=ANSWERS, outputMode="Append", timeMode="ProcessingTime")
    done = answers.withColumn("answer", after_thinking(F.col("answer")))
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def session(spark: SparkSession) -> SparkSession:
    """A session of its own for such queries."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


def finished(spark: SparkSession, out: str) -> int:
    """Answers that are written, as the sink's log has them."""
    try:
        return spark.read.schema(ANSWERS).parquet(out).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def answer_all(spark: SparkSession, path: str, client: Client, out: str, checkpoint: str, files_at_once: int = 100, limit_s: float = 3600, **options) -> DataFrame:
    """Answers all tasks in the Parquet folder path and returns the answers; called again after a stop or a kill, with the same
    folders, it goes on. Stops by itself when every sample of the folder has its row, or after limit_s seconds with an error."""
    own = session(spark)
    tasks = own.read.parquet(path)
    wanted = tasks.select("sample_id", "model").distinct().count()
    stream = own.readStream.schema(tasks.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    query, until = start(stream, client, out, checkpoint, **options), time.time() + limit_s
    try:
        while finished(own, out) < wanted:
            if query.exception() is not None:
                raise query.exception()
            if time.time() > until:
                raise TimeoutError(f"not all of {wanted} samples were answered within {limit_s:g} s")
            query.awaitTermination(1)
    finally:
        query.stop()
    return spark.read.schema(ANSWERS).parquet(out)
