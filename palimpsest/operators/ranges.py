"""Places and running totals over a whole ordered table, without a task that sees more than a range of it.

Rows are dealt over ranges of the order by Spark's range partitioner and written; sums of each range are one small row, and
their running total shifts what each range counts for itself. Ranges grow in number with the rows. The order is a list of
columns, so one value that most rows hold is split by the columns after it; only rows equal in all of them stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.stored import discard, store

#: Rows of a range, about; sampling makes ranges a little uneven.
MOST_ROWS = 1 << 20
#: Smaller tables have a range for each of so many rows, up to the number of shuffle partitions.
LEAST_ROWS = 1 << 12


def range_count(rows: int, partitions: int, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> int:
    """Ranges for a table: as many as there are shuffle partitions, fewer if it is small, more if it is large."""
    return max(1, min(partitions, rows // least), -(-rows // most))


def deal(df: DataFrame, order: list[Column], name: str = "_range", least: int = LEAST_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """Adds the number of the range of `order` that a row falls in, and writes the rows. Equal rows share a range."""
    held = store(df, "held")  # the partitioner reads its input twice
    parts = range_count(held.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least, most)
    if parts == 1:
        alone = held.withColumn(name, F.lit(0))
        alone._written = held._written
        return alone
    dealt = store(held.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()), "dealt")
    discard(held)
    return dealt


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], place: str | None = None, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """Adds to each row the sum of each column of `sums` over all rows before it in `order`, and its place from 1 on.

    Nulls sort as `order` says and count as zero. Rows that are equal in all of `order` come one after another, in any way. An
    empty table stays empty. The order must be columns of df or expressions of them; names beginning with "_range" are taken.
    """
    sums = dict(sums) | ({place: F.lit(1)} if place else {})
    values = {f"_range_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    dealt = deal(df.withColumns(values), order, least=least, most=most)
    totals = dealt.groupBy("_range").agg(*(F.sum(k).alias(k) for k in values))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_range", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_shift") for k in values))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(shift), "_range")
    out = {n: F.col(f"_range_{n}_shift") + F.coalesce(F.sum(f"_range_{n}").over(inside), F.lit(0)) for n in sums}
    if place:
        out[place] = out[place] + 1
    return found.withColumns(out).select(*[c for c in df.columns if c not in out], *out)
