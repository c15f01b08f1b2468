"""Packing, matching and ordered running totals on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import merge, ops, review, search


def test_pack_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "a", 4), (4, "a", 2)], "id long, kind string, size int")
    got = review.pack_skipping(rows, "kind", [F.col("id")], F.col("size"), 10, "id").collect()
    assert [(r.id, r.used) for r in got] == [(1, 5), (3, 9)]


def test_running_total_over_buckets(spark):
    rows = spark.range(100).withColumn("size", F.col("id") % 7)
    got = {r.id: r.before for r in merge.running_total(rows, F.floor(F.col("id") / 9), ["id"], "size").collect()}
    assert got == {i: sum(k % 7 for k in range(i)) for i in range(100)}
    kept = {r.id for r in merge.evict(rows, F.floor(F.col("id") / 9), ["id"], "size", 50).collect()}
    total = sum(k % 7 for k in range(100))
    assert kept == {i for i in range(100) if total - got[i] > 50}


def test_sync_actions(spark):
    e = spark.createDataFrame([(1, "v1", "t", "active", True, False), (2, "v2", "t", "active", True, False), (3, "v1", "u", "active", True, False), (4, "v1", "t", "active", True, True), (5, "v1", "t", "active", False, False), (6, "v1", "t", "active", True, False), (8, "v1", "t", "active", False, False)], "identity int, version string, title string, status string, gated boolean, emptied boolean")
    a = spark.createDataFrame([(k, "v1", "t", "active") for k in (1, 2, 3, 4, 5, 7)], "identity int, version string, title string, status string")
    got = {r.identity: r.action for r in merge.classify_sync(e, a).collect()}
    assert got == {1: "unchanged", 2: "supersede", 3: "repair", 4: "archive:content_cleared", 5: "archive:value_gate", 6: "add", 7: "archive:identity_removed", 8: "ignore"}


def test_authority_ties_stay(spark):
    rows = spark.createDataFrame([(1, "p", "k", 50), (2, "p", "k", 50), (3, "p", "k", 10), (4, "p", "", 10), (5, "p", None, 10)], "chunk_id int, project string, conflict_key string, authority int")
    assert {r.chunk_id for r in search.resolve_authority(rows, ["project"]).collect()} == {1, 2, 4, 5}


def test_percentile_takes_an_element(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(20)] + [(None,)], "v double")
    assert ops.indexed_percentile(rows, "v", 0.95).first().value == 19.0
    assert ops.indexed_percentile(rows, "v", 0.5).first().value == 10.0


def test_scopes(spark):
    rows = spark.createDataFrame([([],), (["all"],), (["a1"],)], "s array<string>")
    of = lambda *a, **k: [r[0] for r in rows.select(search.scope_visible(F.col("s"), *a, **k)).collect()]
    assert of(None) == [True, True, False] and of(None, listing=True) == [True, False, False] and of("a1") == [True, True, True]
