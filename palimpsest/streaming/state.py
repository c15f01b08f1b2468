"""Streaming forms of incremental operators: late events, duplicate suppression, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _plain(value, kind: str):
    """A pandas value as the Python value of a Spark type."""
    if value is None or value != value:
        return None
    if kind.startswith("timestamp"):
        return value.to_pydatetime()
    return int(value) if kind in ("tinyint", "smallint", "int", "bigint") else float(value) if kind in ("float", "double") else bool(value) if kind == "boolean" else value


def latest_state(events: DataFrame, key: str, at: str, rank: str, value: str) -> DataFrame:
    """The state of each key after every micro-batch that changes it; an event with an older time, or at the same time with a
    lower rank, is ignored. Times, ranks and values may be of any simple type. events is a stream; use output mode update."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    names = [at, rank, value]
    state_schema = ", ".join(f"{c} {kinds[c]}" for c in names)

    def step(keys, parts, state: GroupState):
        import pandas as pd

        best = tuple(state.get) if state.exists else None
        before = best
        for p in parts:
            top = p.sort_values([at, rank], kind="stable").iloc[-1]
            new = tuple(_plain(top[c], kinds[c]) for c in names)
            if best is None or new[:2] > best[:2]:
                best = new
        if best != before:
            state.update(best)
            yield pd.DataFrame({key: [keys[0]], **{c: [v] for c, v in zip(names, best, strict=True)}})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {state_schema}", state_schema, "update", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, key: str, at: str, delay_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, first_ms, n): changes of a key are held back until the first pending one is delay_ms old, then told together.

    Unlike a session window, later changes do not prolong the wait. Time is that of the events; at the end of a stream what is
    pending waits for the watermark.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(keys, parts, state: GroupState):
        import pandas as pd

        first, n = tuple(state.get) if state.exists else (None, 0)
        told = []
        if state.hasTimedOut:
            told.append((first, n))
            state.remove()
        else:
            for t in sorted(int(v.timestamp() * 1000) for p in parts for v in p[at]):
                if first is None or t >= first + delay_ms:
                    told += [(first, n)] if first is not None else []
                    first, n = t, 0
                n += 1
            if first + delay_ms <= state.getCurrentWatermarkMs():
                told.append((first, n))
                if state.exists:
                    state.remove()
            else:
                state.update((first, n))
                state.setTimeoutTimestamp(first + delay_ms)
        if told:
            yield pd.DataFrame({key: [keys[0]] * len(told), "first_ms": [x for x, _ in told], "n": [y for _, y in told]})

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first_ms bigint, n bigint", "first_ms bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def suppress_duplicates(events: DataFrame, key: list[str], at: str, window: str) -> DataFrame:
    """Drops events whose key was seen within the window; state older than that is forgotten."""
    return events.withWatermark(at, window).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts in tumbling windows; events later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).count()


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Works off what there is and stops; the checkpoint remembers how far it came."""
    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_new_files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, each read once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)
