"""Running totals over ranges against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ranges


def test_range_count():
    assert [ranges.range_count(n, 200) for n in (0, 1, 4096, 40_960, 10**6, 10**8, 10**9)] == [1, 1, 1, 10, 200, 200, 954]


@pytest.mark.parametrize("least", [7, 4096])
def test_running_total(spark, least):
    rows = [(i, (i * 7919) % 13 if i % 5 else None, (i * 31) % 17 if i % 7 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k int, v int")
    got = ranges.running(df, [F.col("k").desc_nulls_last(), F.col("id")], {"before": F.col("v")}, "place", least=least).collect()
    order, total, want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 0, {}
    for at, (i, k, v) in enumerate(order, 1):
        want[i] = (k, v, total, at)
        total += v or 0
    assert {r.id: (r.k, r.v, r.before, r.place) for r in got} == want


def test_one_value_and_no_rows(spark):
    """A value that nine of ten rows hold is split by the next column."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"))
    dealt = ranges.deal(df, [F.col("k"), F.col("id")], least=1000)
    assert dealt.groupBy("_range").count().agg(F.max("count")).first()[0] < 6000
    got = ranges.running(df, [F.col("k"), F.col("id")], {}, "place", least=1000)
    assert got.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (1, 20_000, 20_000)
    assert ranges.running(df.limit(0), [F.col("k")], {"s": F.col("id")}, "place").count() == 0
