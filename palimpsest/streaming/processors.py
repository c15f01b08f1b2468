"""Stateful operators of streams as state machines of a key: state variables, and timers in event time.

Each takes a stream and gives a stream. State is kept by Spark's store on disk; a query that starts again
from its checkpoint goes on with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.stored import new_folder

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """Keeps the greatest (at, rank) and tells it when it changes."""

    def __init__(self, names: list[str], schema: str):
        self.names, self.schema = names, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.best.get()) if self.best.exists() else None
        best = before
        for r in rows:
            if best is None or (r._at, r._rank) > best[:2]:
                best = (r._at, r._rank, r._value)
        if best != before:
            self.best.update(best)
            yield Row(*self.names)(key[0], *best)

    def close(self) -> None:
        pass


class _Groups(StatefulProcessor):
    """Groups of a key's events, each from its first event for `delay` milliseconds; told when the time is over."""

    def __init__(self, key: str, delay: int):
        self.names, self.delay = [key, "first_ms", "n"], delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ms long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = self.first.get()[0] if self.first.exists() else None
        held, n = first, self.count.get()[0] if self.count.exists() else 0
        for ms in sorted(r._ms for r in rows):
            if first is not None and ms >= first + self.delay:
                yield Row(*self.names)(key[0], first, n)
                first = None
            if first is None:
                first, n = ms, 0
            n += 1
        if first != held:
            if held is not None:
                self.handle.deleteTimer(held + self.delay)
            self.handle.registerTimer(first + self.delay)
        self.first.update((first,))
        self.count.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.first.exists() and self.first.get()[0] + self.delay == expiredTimerInfo.getExpiryTimeInMs():
            yield Row(*self.names)(key[0], self.first.get()[0], self.count.get()[0])
            self.first.clear()
            self.count.clear()

    def close(self) -> None:
        pass


def latest_by_rule(events: DataFrame, key: str, at: str, rank: str, value: str) -> DataFrame:
    """(key, at, rank, value) whenever the state of a key changes: an event of an older time, or of the same time and no higher rank,
    changes nothing, in whatever batch it comes. Use output mode update. Null times and ranks are left out."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    moment = kind[at] == "timestamp"  # kept as microseconds
    schema = f"{at} {'long' if moment else kind[at]}, {rank} {kind[rank]}, {value} {kind[value]}"
    time = F.unix_micros(F.col(at)) if moment else F.col(at)
    rows = events.filter(F.col(at).isNotNull() & F.col(rank).isNotNull()).select(F.col(key).alias("_key"), time.alias("_at"), F.col(rank).alias("_rank"), F.col(value).alias("_value"))
    told = rows.groupBy("_key").transformWithState(_Latest([key, at, rank, value], schema), f"{key} {kind[key]}, {schema}", "Update", "None")
    return told.withColumn(at, F.timestamp_micros(at)) if moment else told


def grouped_changes(events: DataFrame, key: str, at: str, delay_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, first_ms, n): the changes of a key from the first pending one on for delay_ms, told once the watermark is past that or
    a later change of the key comes. Later changes do not prolong the wait. Use output mode append; events that are later than
    the watermark by `late` are left out by Spark. What is pending when a stream stops waits in the state."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(at, late).select(F.col(key).alias("_key"), F.col(at).alias("_time"), F.unix_millis(F.col(at)).alias("_ms"))
    return rows.groupBy("_key").transformWithState(_Groups(key, delay_ms), f"{key} {kind}, first_ms long, n long", "Append", "EventTime")


def drained(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str, files: int = 4, a_trigger: int | None = None) -> DataFrame:
    """What a stream of a table's rows gives until all is read: rows are written as files, streamed and worked off; every output row
    comes with the number of its batch. All folders lie in the shared folder."""
    source, out, checkpoint = (new_folder(spark, n) for n in ("stream", "told", "checkpoint"))
    rows.repartition(files).write.parquet(source)
    reader = spark.readStream.schema(rows.schema)
    stream = make((reader.option("maxFilesPerTrigger", a_trigger) if a_trigger else reader).parquet(source))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, _PROVIDER)
    try:
        done = stream.writeStream.queryName(f"drained-{uuid.uuid4().hex}").foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        spark.conf.set(name, before)
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
