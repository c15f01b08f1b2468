"""Streams of whole tables, drained: state machines give what one batch over all rows gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.timefns import micros
from palimpsest.operators.stored import new_folder
from palimpsest.plans.registry import query
from palimpsest.plans.tables import table
from palimpsest.sources import lines
from palimpsest.streaming.processors import drained, grouped_changes, latest_by_rule

DELAY_MS = 3_600_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.timestamp_millis((micros(F.col("ts")) / 1000).cast("long")).alias("at"))


@query("select user_id, arg_max(event_type, (epoch_us(ts) // 1000, event_id)) as event_type, arg_max(event_id, (epoch_us(ts) // 1000, event_id)) as event_id from events group by user_id")
def streamed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user by time and number; events come in two batches, in no order, so many come late."""
    told = drained(spark, _events(spark, sf_dir), lambda s: latest_by_rule(s, "user_id", "at", "event_id", "event_type"), "update", a_trigger=2)
    last = told.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), "batch").alias("x"))
    return last.select("user_id", "x.event_type", "x.event_id")


_GROUPS = f"""
e as (select user_id, epoch_us(ts) // 1000 as ms from events), l as (select user_id, list_sort(list(ms)) as all_ms from e group by user_id),
f as (select user_id, list_reduce(list_transform(all_ms, lambda x: [x]), lambda a, x: case when x[1] >= a[-1] + {DELAY_MS} then list_concat(a, x) else a end) as firsts from l),
u as (select user_id, unnest(firsts) as first_ms from f), n as (select user_id, first_ms, lead(first_ms) over (partition by user_id order by first_ms) as next_ms from u)"""


@query(f"""
with {_GROUPS} :: select n.user_id, first_ms, count(*) as n from n join e on e.user_id = n.user_id and ms >= first_ms and (next_ms is null or ms < next_ms)
where first_ms + {DELAY_MS} <= (select max(ms) from e) group by all
""")
def streamed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user told together, an hour from the first; what is pending at the end is not told."""
    return drained(spark, _events(spark, sf_dir), lambda s: grouped_changes(s, "user_id", "at", DELAY_MS), "append").drop("batch")


@query(f"with {_GROUPS} :: select user_id, first_ms from u where first_ms + {DELAY_MS} <= (select max(ms) from e)")
def streamed_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user in an hour from it, repeats suppressed."""
    told = drained(spark, _events(spark, sf_dir), lambda s: grouped_changes(s, "user_id", "at", DELAY_MS), "append")
    return told.select("user_id", "first_ms")


@query("select conv_id, turn, role, text from conversations")
def archive_lines_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns through an archive of lines that grows between two runs of one query: each line is read once, from stored positions."""
    lines.register(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    folder, out, checkpoint = (new_folder(spark, n) for n in ("archive", "read", "checkpoint"))
    for part in (rows.filter("conv_id % 2 = 0"), rows.filter("conv_id % 2 = 1")):
        part.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).write.mode("append").option("lineSep", "\n").text(folder)
        stream = spark.readStream.format(lines.FORMAT).option("suffix", ".txt").load(folder)
        parsed = stream.select(F.from_json("line", rows.schema).alias("r")).select("r.*")
        parsed.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
