"""Writes of the read model as new states of tables: batches, rebuilds, links, projections, decisions, vectors, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.textfns import redact
from palimpsest.operators import merge


def numbered(rows: DataFrame, by: Column, order: list[str], start: int = 0, name: str = "ordinal") -> DataFrame:
    """Rows with their place in order from `start`; by is a number that ascends with order. Places are counted over ranges."""
    placed = merge.running_total(rows.withColumn("_one", F.lit(1)), by, order, "_one", name).drop("_one")
    return placed.withColumn(name, F.col(name) + start)


def bundle_upsert(old: DataFrame, new: DataFrame, key: str, by: Column, order: list[str], start: int) -> DataFrame:
    """A batch of new rows over old ones: each gets its ordinal in the batch, and a known row keeps its first created time."""
    return merge.upsert(old, numbered(new, by, order, start), [key], keep_first=("created",))


def rebuild(old: DataFrame, new: DataFrame, key: str, stays: Column) -> DataFrame:
    """All rows made anew, but those that a rebuild does not make stay as they are."""
    kept = old.filter(stays)
    return kept.unionByName(new.join(kept.select(key), key, "left_anti").select(*old.columns))


def unlink(links: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return links.join(gone.select(*key), key, "left_anti")


def verify_links(expected: DataFrame, links: DataFrame, per: str, key: list[str]) -> DataFrame:
    """(per, expected, found, verified): whether each expected link of a group is stored."""
    hits = expected.join(links.select(*key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hits.groupBy(per).agg(F.count("*").alias("expected"), F.count("_hit").alias("found")).withColumn("verified", F.col("expected") == F.col("found"))


def project_states(projections: DataFrame, evidence: DataFrame, links: DataFrame, key: str, ref: str) -> DataFrame:
    """(key, state) of derived projections after a step.

    One that is prepared becomes active if the set of its evidence equals the set of its links, and needs repair if not; an
    active one whose sets differ needs repair; one asked to go is removed. Sets are compared by counts of a full outer join.
    """
    e = evidence.select(key, ref).distinct().withColumn("_e", F.lit(1))
    has = links.select(key, ref).distinct().withColumn("_l", F.lit(1))
    differ = e.join(has, [key, ref], "full_outer").groupBy(key).agg(F.count_if(F.col("_e").isNull() | F.col("_l").isNull()).alias("_d"))
    proven = F.coalesce(F.col("_d"), F.lit(0)) == 0
    state = F.when(F.col("wanted") == "remove", "removed").when(F.col("state").isin("prepared", "active"), F.when(proven, "active").otherwise("repair_required")).otherwise(F.col("state"))
    return projections.join(differ, key, "left").select(key, state.alias("state"))


def supersede(decisions: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Decisions after new ones of the same key: the active one is closed where the new authority is not lower; else the new
    one is refused and nothing changes. decisions and new: (key, version, authority, since, state, until).

    Several new ones of a key are taken in order of (since, version): each closes the one before it, and is refused if any that
    was taken before it has a higher authority. Only the last one taken is active.
    """
    active = decisions.filter("state = 'active'").groupBy(key).agg(F.max("authority").alias("_a"))
    turn = Window.partitionBy(key).orderBy("since", "version")
    most = F.greatest("_a", F.max("authority").over(turn.rowsBetween(Window.unboundedPreceding, -1)))
    judged = new.join(active, key, "left").withColumn("_most", most)
    taken = judged.filter(F.col("_most").isNull() | (F.col("authority") >= F.col("_most"))).drop("_a", "_most")
    following = F.lead("since").over(turn)
    taken = taken.withColumn("_next", following).withColumn("until", F.coalesce("_next", "until")).withColumn("state", F.when(F.col("_next").isNotNull(), "superseded").otherwise(F.col("state"))).drop("_next")
    closing = taken.groupBy(key).agg(F.min("since").alias("_until"))
    hit = (F.col("state") == "active") & F.col("_until").isNotNull()
    old = decisions.join(closing, key, "left").withColumn("until", F.when(hit, F.col("_until")).otherwise(F.col("until")))
    old = old.withColumn("state", F.when(hit, "superseded").otherwise(F.col("state"))).drop("_until")
    return old.unionByName(taken)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def archive(rows: DataFrame, old: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """(history, rest): rows that move to the history with the time of it, and those that stay."""
    return rows.filter(old).withColumn("archived_at", at), rows.filter(~F.coalesce(old, F.lit(False)))


def index_by_stat(old: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """(path, change) of an index over files: equal size and time leave an entry as it is, others are read anew."""
    a = old.select(path, F.struct("size", "modified").alias("_a"))
    b = files.select(path, F.struct("size", "modified").alias("_b"))
    change = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("updated")
    return a.join(b, path, "full_outer").select(path, change.alias("change"))


def coordinate(before: DataFrame, after: DataFrame, key: str, fingerprint: str, full: bool = False) -> DataFrame:
    """(key, call) that bring a vector index in step with the chunks: delete what is gone, upsert what is new or changed; a full
    rebuild upserts all."""
    told = merge.diff(before, after, key, fingerprint)
    call = F.when(F.col("change") == "removed", "delete").when(F.col("change").isin("added", "updated") | F.lit(full), "upsert")
    return told.select(key, call.alias("call")).filter("call is not null")


def revoke_running(scans: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """Scans whose source is no longer authorised fail while they run; ended ones stay as they are."""
    known = sources.select(source, F.col("status").alias("_s"))
    lost = F.coalesce(F.col("_s") != "authorized", F.lit(True)) & F.col("status").isin("queued", "running")
    return scans.join(known, source, "left").withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).drop("_s")


def content_addressed(rows: DataFrame, text: str, key: str, folder: str = "raw") -> DataFrame:
    """(path, uses, first_id) of the files that keep each text once: named by its SHA-256, in folders of its first two digits."""
    digest = F.sha2(F.col(text).cast("binary"), 256)
    path = F.concat(F.lit(f"{folder}/"), F.substring(digest, 1, 2), F.lit("/"), digest)
    return rows.groupBy(path.alias("path")).agg(F.count("*").alias("uses"), F.min(key).alias("first_id"))


def sink(stored: DataFrame, batch: DataFrame, key: str, text: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The read model after a batch: its texts masked first, so that no secret is stored, then merged by key."""
    return merge.upsert(stored, batch.withColumn(text, redact(F.col(text))), [key], keep_first)
