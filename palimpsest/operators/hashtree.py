"""Reconciling two stored tables by a tree of digests, so that only ranges of keys that differ are read.

Rows lie in folders by a hash of their key, and each folder has a digest: how many rows, and the sums of two 64-bit hashes of (key,
fingerprint). Sums do not hang on an order and can be added, so a change keeps digests up by adding what comes and taking away
what goes. Two tables are compared from the root: equal digests end it there; else groups of folders, then folders; rows are
read from the folders that differ only. Counts alone would miss a row gone and another come; the sums see it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.merge import diff
from palimpsest.operators.projection import Change, Projection

#: Folders of a table, and folders of a group in the tree.
LEAVES, GROUP = 256, 16


def leaf(key: Column, leaves: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(leaves)).cast("int")


def _sums(rows: DataFrame, key: str, fingerprint: str, sign: int = 1) -> DataFrame:
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col(key), F.col(fingerprint)).cast("decimal(38,0)") * sign).cast("decimal(38,0)")
    return rows.groupBy("leaf").agg((F.count(F.lit(1)) * sign).alias("n"), wide(1).alias("a"), wide(2).alias("b"))


class DigestedTable:
    """Rows (key, fingerprint, more) by leaf, with digests. Keys are one row each."""

    def __init__(self, spark: SparkSession, root: str, key: str, fingerprint: str, leaves: int = LEAVES):
        self.spark, self.key, self.fingerprint, self.leaves = spark, key, fingerprint, leaves
        self.store = Projection(spark, root, {"rows": key, "digests": "leaf"})

    def commit(self, rows: DataFrame, mark: str, removed: DataFrame | None = None) -> bool:
        """Puts rows in place of those of the same key and takes out removed keys; rows and digests change at once. Of what is
        there, only the leaves of changed keys are read."""
        now = self.store.manifest()
        if now is not None and now.fingerprint == mark:
            return False
        new = rows.withColumn("leaf", leaf(F.col(self.key), self.leaves))
        digests = _sums(new, self.key, self.fingerprint)
        if now is not None:
            keys = new.select(self.key, "leaf")
            if removed is not None:
                keys = keys.unionByName(removed.select(self.key).withColumn("leaf", leaf(F.col(self.key), self.leaves)))
            touched = [r.leaf for r in keys.select("leaf").distinct().collect()]  # at most `leaves`
            old = self.store.read("rows", now).filter(F.col("leaf").isin(touched)).join(keys.select(self.key).distinct(), self.key, "left_semi")
            digests = digests.unionByName(_sums(old, self.key, self.fingerprint, -1))
        digests = digests.groupBy("leaf").agg(*(F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in "nab"))
        return self.store.commit({"rows": Change(new.repartition("leaf"), removed, by=("leaf",)), "digests": Change(digests, replaces=False)}, mark)

    def digests(self, level: Column) -> DataFrame:
        """Digests of the folders, or of groups of them, that hold rows."""
        summed = self.store.read("digests").groupBy(level.alias("node")).agg(*(F.sum(c).alias(c) for c in "nab"))
        return summed.filter((F.col("n") != 0) | (F.col("a") != 0) | (F.col("b") != 0))

    def rows(self, leaves: list[int]) -> DataFrame:
        return self.store.read("rows").filter(F.col("leaf").isin(leaves))


def _unlike(a: DataFrame, b: DataFrame) -> list[int]:
    both = a.withColumnsRenamed({c: f"{c}_" for c in "nab"}).join(b, "node", "full_outer")
    same = F.lit(True)
    for c in "nab":
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return sorted(r.node for r in both.filter(~same).select("node").collect())  # at most one row a node of the level


def differing(before: DigestedTable, after: DigestedTable, group: int = GROUP) -> list[int]:
    """The leaves whose rows differ, told from digests level by level."""
    if before.leaves != after.leaves:
        raise ValueError("both tables must have the same leaves")
    if not _unlike(before.digests(F.lit(0)), after.digests(F.lit(0))):
        return []
    by_group = F.floor(F.col("leaf") / group).cast("int")
    groups = _unlike(before.digests(by_group), after.digests(by_group))
    inside = lambda t: t.digests(F.col("leaf")).filter(F.floor(F.col("node") / group).cast("int").isin(groups))
    return _unlike(inside(before), inside(after))


def reconcile(before: DigestedTable, after: DigestedTable) -> DataFrame:
    """(key, change) of the keys that were added, removed or updated; unchanged keys are left out."""
    leaves = differing(before, after)
    return diff(before.rows(leaves), after.rows(leaves), before.key, before.fingerprint).filter(F.col("change") != "unchanged")
