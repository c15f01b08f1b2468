"""Write-side operators: upserts, inheritance, diffs, versions, late events, retention. Each gives the new state as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ranges import running


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_first: tuple[str, ...] = (), order: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of old with the same key; columns in keep_first stay as they were first. Of several new rows of
    a key the last in `order` counts, by default the greatest of all values. old has one row a key."""
    values = [c for c in old.columns if c not in key]
    n = latest(new, key, order or values).select(*key, F.struct(*values).alias("_n"))
    o = old.select(*key, F.struct(*values).alias("_o"))
    pick = lambda c: F.coalesce(F.col(f"_o.{c}"), F.col(f"_n.{c}")) if c in keep_first else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    return o.join(n, key, "full_outer").select(*key, *(pick(c).alias(c) for c in values))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key are taken from new where it has any: delete, then insert."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def inherit(child: DataFrame, parent: DataFrame, key: str, column: str, stored: DataFrame | None = None, child_key: str = "") -> DataFrame:
    """A value given in the row wins and clears the flag; else what is stored for the row holds with the flag it has; else the
    parent's value, with the flag set. stored: (child_key, column, column_inherited), one row a child."""
    up, flag = parent.select(key, F.col(column).alias("_up")), f"{column}_inherited"
    both = child.join(up, key, "left")
    if stored is not None:
        both = both.join(stored.select(child_key, F.col(column).alias("_was"), F.col(flag).alias("_flag")), child_key, "left")
    else:
        both = both.withColumns({"_was": F.lit(None).cast(child.schema[column].dataType), "_flag": F.lit(None).cast("boolean")})
    told = F.when(F.col(column).isNotNull(), False).when(F.col("_was").isNotNull(), F.coalesce("_flag", F.lit(False))).otherwise(True)
    return both.withColumn(flag, told).withColumn(column, F.coalesce(column, "_was", "_up")).drop("_up", "_was", "_flag")


def diff(before: DataFrame, after: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, change): added, removed, updated or unchanged."""
    a = before.select(key, F.col(fingerprint).alias("_a"), F.lit(1).alias("_in_a"))
    b = after.select(key, F.col(fingerprint).alias("_b"), F.lit(1).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def classify_sync(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What a sync of content-addressed evidence does with each version.

    expected: identity, version, title, status, gated (passes the value gate), emptied. actual: identity, version, title,
    status of stored active versions. A new version of a known identity supersedes the stored one; a drift of title or status
    is repaired in place; identities that are gone, emptied or below the gate are archived, with the reason.
    """
    e = expected.select("identity", "gated", "emptied", F.struct("version", "title", "status").alias("e"))
    a = actual.select("identity", F.struct("version", "title", "status").alias("a"))
    both = e.join(a, "identity", "full_outer")
    action = (
        F.when(F.col("e").isNull(), "archive:identity_removed")
        .when(F.col("emptied"), F.when(F.col("a").isNotNull(), "archive:content_cleared").otherwise("ignore"))
        .when(~F.col("gated"), F.when(F.col("a").isNotNull(), "archive:value_gate").otherwise("ignore"))
        .when(F.col("a").isNull(), "add")
        .when(F.col("e.version") != F.col("a.version"), "supersede")
        .when((F.col("e.title") != F.col("a.title")) | (F.col("e.status") != F.col("a.status")), "repair")
        .otherwise("unchanged")
    )
    return both.select("identity", action.alias("action"))


def apply_sync(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The stored versions after a sync, with state and reason: new ones added, superseded ones closed, the rest repaired,
    archived or kept. One full outer join; what becomes of an identity is one array of versions, exploded."""
    kinds = classify_sync(expected, actual)
    new = expected.select("identity", F.col("version").alias("_nv"), F.col("title").alias("_nt"))
    old = actual.select("identity", F.col("version").alias("_ov"), F.col("title").alias("_ot"))
    both = kinds.join(new, "identity", "left").join(old, "identity", "left")
    row = lambda v, t, state, reason: F.struct(F.col(v).alias("version"), F.col(t).alias("title"), F.lit(state).alias("state"), reason.cast("string").alias("reason"))
    none = F.lit(None)
    active, kept = row("_nv", "_nt", "active", none), row("_ov", "_ot", "active", none)
    versions = (
        F.when(F.col("action").isin("add", "repair"), F.array(active)).when(F.col("action") == "supersede", F.array(active, row("_ov", "_ot", "superseded", F.lit("new_version"))))
        .when(F.col("action") == "unchanged", F.array(kept)).when(F.startswith("action", F.lit("archive:")), F.array(row("_ov", "_ot", "archived", F.substring("action", 9, 64))))
    )
    return both.select("identity", F.explode(versions).alias("v")).select("identity", "v.*")


def close_versions(history: DataFrame, key: str, order: list[str], start: str) -> DataFrame:
    """Every version but the last of a key ends where the next one starts, and is superseded."""
    nxt = F.lead(start).over(Window.partitionBy(key).orderBy(*order))
    return history.withColumn("valid_to", nxt).withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("state", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by order; older or lower ones are ignored, in whatever order they come."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*key, "_best.*")


def newest(rows: DataFrame, per: list[str] | None, order: list[Column], k: int) -> DataFrame:
    """The first k rows in order, of each group or of all. Without groups it is a limit, so no window over all rows is made."""
    if not per:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("_place") <= k).drop("_place")


def ranged(rows: DataFrame, by: Column, n: int = 256, name: str = "_range") -> DataFrame:
    """Adds the number of one of n ranges of `by`, which must be a number; ranges ascend and hold about equally many rows. Nothing
    is written for it, unlike ranges.deal, but n is fixed and rows of one value stay together.

    The edges are approximate percentiles: one row of n - 1 numbers, whatever the number of rows. A row finds its range by
    two steps of about sqrt(n) comparisons.
    """
    step = max(1, int(n**0.5))
    edges = rows.agg(F.percentile_approx(by, [k / n for k in range(1, n)], 100 * n).alias("_edges"))
    below = lambda array: F.size(F.filter(array, lambda e: e < by))
    coarse = below(F.transform(F.sequence(F.lit(step), F.lit(n - 1), F.lit(step)), lambda i: F.get("_edges", i - 1)))
    found = rows.crossJoin(F.broadcast(edges)).withColumn("_coarse", F.coalesce(coarse, F.lit(0)))
    fine = below(F.slice("_edges", F.col("_coarse") * step + 1, F.lit(step)))
    return found.withColumn(name, F.col("_coarse") * step + F.coalesce(fine, F.lit(0))).drop("_edges", "_coarse")


def running_total(rows: DataFrame, by: Column, order: list[str], size: str, name: str = "before") -> DataFrame:
    """Adds the total of size of all rows that come before, over ranges of (by, order) that grow in number with the rows.

    `by` ascends with order, which may tell rows of one value apart: a value that most rows hold then is dealt over many ranges.
    """
    return running(rows, [by, *map(F.col, order)], {name: F.col(size)})


def evict(rows: DataFrame, by: Column, order: list[str], size: str, cap: int) -> DataFrame:
    """The oldest rows that must go until the rest is within the cap."""
    total = rows.agg(F.sum(size).alias("_total"))
    return running_total(rows, by, order, size).crossJoin(F.broadcast(total)).filter(F.col("_total") - F.col("before") > cap).drop("_total")


def missing(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return expected.join(stored.select(key), key, "left_anti")


def record_once(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New events whose id the log does not hold yet, one of each."""
    return new.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def increment(rows: DataFrame, new: DataFrame, session: str) -> DataFrame:
    """All rows of the sessions that have new rows: sessions are exported as a whole, so an increment stands for itself."""
    return rows.join(new.select(session).distinct(), session, "left_semi")
