"""Hourly panes of clicks, published once their grace is over and revised until they are closed.

Batches of clicks are written to the shared folder and moved, one after the other, into the folder that a streaming query
watches; the query is started anew for each of them on one checkpoint. Its state is a ValueState for each pane (kind,
hour) with what was counted and what was published; one event-time timer ends the grace of a pane and publishes it,
another closes it and forgets its state.

The stream's clock is Spark's watermark. Rows carry the hour that the clock has reached, whichever is later, their own or
that of the batches before, and the number of their batch as milliseconds. All times that matter are whole hours, so the
clock is exact; it grows with every batch, so Spark drops no row as late, and rows of closed panes reach the operator, which
writes them as such. A row without a click is in each batch, so that empty ones move the clock's work on, and the one of the
last batch carries the end of time: the timers that are left then fire and say that their panes are final.

Rows are summed by pane in the tasks that read them, before the shuffle; rows of closed panes have no state to meet and are
dealt evenly. So a pane with a third of all rows costs its task no more than another.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codegrain.sources.shared import move, scratch

HOUR_MS = 3_600_000
#: Added to event times, so that the clock starts before all of them; times further from 1970 count as this far for the clock.
ORIGIN_HOURS = 24 * 365 * 60
#: The hour of the clock that no event reaches.
END_HOURS = 3 * ORIGIN_HOURS
#: Partial sums that a task holds before it hands them on.
HELD_PANES = 50_000

STAGED = "click_id long, kind string, hour long, cents long, tick boolean"
#: No column has nulls: pandas would make floats of the numbers beside them.
DEALT = "kind string, hour long, slot int, click_id long, known boolean, own_kind string, own_hour long, n long, cents long, clock timestamp"
RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"


def day_of(moment: Column) -> Column:
    return F.unix_date(F.to_date(moment)).cast("long")


def second_of(moment: Column) -> Column:
    """Whole seconds since 1970 by the clock that the timestamp shows; no zone has a say. Hours need no more."""
    return day_of(moment) * 86_400 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)


def batched(clicks: DataFrame, n_batches: int, spread: int = 30, still: int = 23) -> DataFrame:
    """(batch, click_id, kind, hour, cents, tick): each click once, in the batch in which it comes.

    A click comes in the batch of its day of arrival modulo n_batches, some up to spread - still - 1 batches later by a hash
    of its id, none after the last; its event time is moved with that day. Rows without ts are dropped; without arrived_at
    they arrive at ts. Of rows that share a click_id the one that arrived first counts, then the smallest in its other columns;
    a null click_id is one like any other. A null kind is 'none', a null or non-finite value 0. Other columns are ignored.
    """
    first = F.min(F.struct(F.coalesce("arrived_at", "ts").alias("came"), "ts", "kind", "value"))
    once = clicks.where("ts is not null").select("click_id", "ts", "arrived_at", F.col("kind").cast("string").alias("kind"), F.col("value").cast("double").alias("value")).groupBy("click_id").agg(first.alias("c"))
    day = day_of(F.col("c.came"))
    start = F.pmod(day, F.lit(n_batches))
    delay = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % spread - still)
    second = second_of(F.col("c.ts")) - (day - start) * 86_400
    value = F.when(F.abs("c.value") < float("inf"), F.col("c.value")).otherwise(0.0)
    return once.select(
        F.least(F.lit(n_batches - 1), start + delay).cast("int").alias("batch"), "click_id", F.coalesce("c.kind", F.lit("none")).alias("kind"),
        F.floor((second - F.pmod(second, F.lit(3600))) / 3600).cast("long").alias("hour"), F.floor(value * 100 + 0.5).cast("long").alias("cents"), F.lit(False).alias("tick"),
    )


def _whole(x: int) -> int:
    """x as a 64-bit sum would have it."""
    return (int(x) + (1 << 63)) % (1 << 64) - (1 << 63)


class Panes(StatefulProcessor):
    """Keys are (kind, hour, slot): slot -1 for a pane, others for rows of closed panes and for the row without a click."""

    def __init__(self, batch: int, grace_hours: int, close_hours: int):
        self.batch, self.grace, self.close_ms = batch, grace_hours * HOUR_MS, close_hours * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, cents long, published boolean, published_n long, published_cents long")

    def _end(self, hour: int) -> int:
        return (hour + 1 + ORIGIN_HOURS) * HOUR_MS

    def _rows(self, key, *records: tuple[str, int, int]) -> pd.DataFrame:
        return pd.DataFrame([(self.batch, key[1], -1, n, cents, record, key[0]) for record, n, cents in records], columns=["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"])

    def _publish(self, key, record: str) -> Iterator[pd.DataFrame]:
        n, cents, published, _, _ = self.totals.get()
        if not published:
            self.totals.update((n, cents, True, n, cents))
            yield self._rows(key, (record, n, cents))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, hour, slot = key
        if slot >= 0:
            for late in rows:
                late = late[late["n"] > 0]
                if len(late):
                    click_id = late["click_id"].astype("Int64").where(late["known"])
                    yield pd.DataFrame({"batch": self.batch, "hour": late["own_hour"], "click_id": click_id, "n_rows": late["n"], "cents": late["cents"], "record": "late", "kind": late["own_kind"]})
            return
        now, end = timerValues.getCurrentWatermarkInMs(), self._end(hour)
        if now >= end + self.close_ms:
            raise ValueError("rows of a closed pane were summed")
        fresh, more = [sum(int(x) for x in sums) for sums in zip(*((f["n"].sum(), f["cents"].sum()) for f in rows), strict=True)]
        if self.totals.exists():
            n, cents, published, published_n, published_cents = self.totals.get()
        else:
            n, cents, published, published_n, published_cents = 0, 0, False, 0, 0
            self.handle.registerTimer(end + self.grace)
            self.handle.registerTimer(end + self.close_ms)
        n, cents = n + fresh, _whole(cents + more)
        if published:
            self.totals.update((n, cents, True, n, cents))
            yield self._rows(key, ("retract", published_n, published_cents), ("replace", n, cents))
            return
        self.totals.update((n, cents, False, 0, 0))
        if now >= end + self.grace:
            yield from self._publish(key, "emit")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.totals.exists():
            return
        over = timerValues.getCurrentWatermarkInMs() >= END_HOURS * HOUR_MS
        yield from self._publish(key, "final" if over else "emit")
        if expiredTimerInfo.getExpiryTimeInMs() == self._end(key[1]) + self.close_ms:
            self.totals.clear()


def summed(rows: DataFrame, batch: int, reached: int | None, last: bool, close_hours: int, slots: int) -> DataFrame:
    """DEALT rows of one batch: sums of each task for each pane that is open, and the rows of closed ones as they are. reached:
    the last hour of the batches before."""
    hour = F.least(F.greatest(F.col("hour"), F.lit(-ORIGIN_HOURS if reached is None else reached)), F.lit(ORIGIN_HOURS))
    at = F.when(F.col("tick"), F.lit(END_HOURS if last else ORIGIN_HOURS + (-ORIGIN_HOURS if reached is None else min(reached, ORIGIN_HOURS)))).otherwise(hour + ORIGIN_HOURS)
    clocked = rows.select("click_id", "kind", "hour", "cents", "tick", F.timestamp_millis(at * HOUR_MS + batch + 1).alias("clock"), F.pmod(F.xxhash64("click_id"), F.lit(slots)).cast("int").alias("slot"))
    closed = None if reached is None else reached - close_hours - 1  # the last hour of which panes are closed

    def partial(t: pa.Table) -> pa.Table:
        sums = t.group_by(["kind", "hour"], use_threads=False).aggregate([("n", "sum"), ("cents", "sum"), ("clock", "max")])
        return sums.select(["kind", "hour", "n_sum", "cents_sum", "clock_max"]).rename_columns(["kind", "hour", "n", "cents", "clock"])

    def out(t: pa.Table, alone: bool) -> Iterator[pa.RecordBatch]:
        same = lambda value, kind: pa.array([value] * t.num_rows, kind)
        zero, empty = same(0, pa.int64()), same("", pa.string())
        if alone:
            n, filled = pc.if_else(t["tick"], 0, 1), lambda c, value: pc.fill_null(t[c], value)
            columns = [empty, zero, t["slot"], filled("click_id", 0), pc.is_valid(t["click_id"]), filled("kind", ""), filled("hour", 0), n.cast(pa.int64()), filled("cents", 0), t["clock"]]
        else:
            columns = [t["kind"], t["hour"], same(-1, pa.int32()), zero, same(False, pa.bool_()), empty, zero, t["n"], t["cents"], t["clock"]]
        names = [c.split()[0] for c in DEALT.split(", ")]
        yield from pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            alone = t["tick"] if closed is None else pc.or_(t["tick"], pc.less_equal(t["hour"], closed))
            alone = pc.fill_null(alone, True)
            yield from out(t.filter(alone), True)
            open_ = t.filter(pc.invert(alone))
            if open_.num_rows:
                new = partial(open_.append_column("n", pa.array([1] * open_.num_rows, pa.int64())))
                held = new if held is None else partial(pa.concat_tables([held, new]))
                if held.num_rows > HELD_PANES:
                    yield from out(held, False)
                    held = None
        if held is not None:
            yield from out(held, False)

    return clocked.mapInArrow(run, DEALT)


def _session(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream's settings: state in RocksDB, no batches but those that are fed."""
    own = spark.newSession()
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # each start needs its stores once
    }.items():
        own.conf.set(key, value)
    return own


def revised(clicks: DataFrame, n_batches: int = 10, grace_hours: int = 12, close_hours: int = 48) -> DataFrame:
    """(batch, hour, click_id, n_rows, cents, record, kind): what the panes of clicks (click_id, ts, arrived_at, kind, value)
    write, batch by batch.

    record is 'late' for a row of a closed pane (with its click_id, -1 for all others), 'emit' for a pane whose grace is over,
    'retract' and 'replace' with the old and new totals for a published pane that got rows, 'final' for those that are not
    published when all batches are through. batched() says what becomes of nulls and repeated rows. No clicks, no records.
    Sums are 64-bit. Spark's own streaming state and files under spark.checkpoint.dir hold everything between the batches,
    the driver one hour for each of them.
    """
    spark = clicks.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process beside the driver that asks Panes for its states gets no shipped files
    home = scratch(spark)
    staged, fed, out, checkpoint = (f"{home}/{x}" for x in ("staged", "fed", "records", "checkpoint"))
    batched(clicks, n_batches).write.partitionBy("batch").parquet(staged)
    ticks = spark.range(n_batches, numPartitions=1).select(F.col("id").cast("int").alias("batch"), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STAGED.split(", ")[:-1]), F.lit(True).alias("tick"))
    ticks.write.mode("append").partitionBy("batch").parquet(staged)
    latest = spark.read.schema(STAGED + ", batch int").parquet(staged).where("not tick").groupBy("batch").agg(F.max("hour").alias("hour")).collect()  # a row for each batch
    by_batch = {r["batch"]: r["hour"] for r in latest}

    own, reached = _session(spark), None
    for batch in range(n_batches):
        last = batch == n_batches - 1
        move(spark, f"{staged}/batch={batch}", f"{fed}/batch={batch}")
        # the last batch is followed by one without rows, whose clock is the end of time
        own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(last).lower())
        rows = own.readStream.schema(STAGED + ", batch int").parquet(fed)
        slots = 2 * int(own.conf.get("spark.sql.shuffle.partitions"))
        dealt = summed(rows, batch, reached, last, close_hours, slots).withWatermark("clock", "0 seconds")
        records = dealt.groupBy("kind", "hour", "slot").transformWithStateInPandas(Panes(batch, grace_hours, close_hours), outputStructType=RECORDS, outputMode="Append", timeMode="EventTime")
        records.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        if batch in by_batch:
            reached = by_batch[batch] if reached is None else max(reached, by_batch[batch])
    return spark.read.schema(RECORDS).parquet(out)
