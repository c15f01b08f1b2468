"""Versioned projections: several tables that change together, by two phases and one rename.

A projection is a folder. A change is prepared as segments, one folder a table with the rows that are new and the keys that they
replace or remove; then a manifest that names every segment of every table is written aside and renamed to its number. The rename
is the commit: whoever reads takes the manifest of the highest number, so readers see all tables before the change or all after
it. What was prepared and never activated belongs to no manifest; repair deletes it, and the same change made again ends in the
same state. A change with the fingerprint of the last one writes nothing. Rows are merged when they are read: a row lives unless a
later segment names its key. Renames must be atomic and refuse an existing target, as in HDFS and local folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.operators.stored import filesystem, shuffles_dropped

#: Segments of a table that compact leaves alone.
MOST_SEGMENTS = 8


@dataclass
class Change:
    """What happens to a table: rows to add, and the keys of rows to remove first. All rows of rows' own keys are replaced.
    rows may be made of what the same change has written to the tables before this one."""

    rows: DataFrame | Callable[[dict[str, DataFrame]], DataFrame]
    removed: DataFrame | None = None
    by: tuple[str, ...] = ()  # columns that folders are made of
    sort: tuple[str, ...] = ()
    replaces: bool = True


@dataclass
class Manifest:
    number: int
    fingerprint: str
    tables: dict[str, list[dict]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class Projection:
    """keys: the key column of each table."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.fs, _ = filesystem(spark, self.root)
        self._read: dict[tuple[str, int], DataFrame] = {}

    # files

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _text(self, *parts: str) -> str:
        return bytes(self.fs.open(self._at(*parts)).readAllBytes()).decode()

    def _put(self, text: str, *parts: str) -> None:
        out = self.fs.create(self._at(*parts), False)
        out.write(bytearray(text.encode()))
        out.close()

    # state

    def manifest(self) -> Manifest | None:
        """The state that readers see: the manifest of the highest number."""
        known = [n for n in self._names("manifests") if n.endswith(".json")]
        return Manifest(**json.loads(self._text("manifests", known[-1]))) if known else None

    def read(self, table: str, at: Manifest | None = None) -> DataFrame:
        """The living rows of a table. Without a manifest there is nothing to read, which is an error. The listing of a state's
        files is kept with it, for they never change."""
        state = at or self.manifest()
        if state is None or table not in state.tables:
            raise ValueError(f"{table} has no committed state in {self.root}")
        if (table, state.number) not in self._read:
            self._read = {k: v for k, v in self._read.items() if k[1] >= state.number}
            self._read[table, state.number] = self._merged(table, state)
        return self._read[table, state.number]

    def _merged(self, table: str, state: Manifest) -> DataFrame:
        segments, key = state.tables[table], self.keys[table]
        rows = None
        for s in segments:
            kind = StructType.fromJson(json.loads(s["schema"]))
            part = self.spark.read.schema(kind).parquet(f"{self.root}/{s['rows']}").withColumn("_at", F.lit(s["number"]))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        first = min(s["number"] for s in segments)
        later = [s for s in segments if s["gone"] and s["number"] > first]
        if later:
            gone = None
            for s in later:
                part = self.spark.read.parquet(f"{self.root}/{s['gone']}").withColumn("_until", F.lit(s["number"]))
                gone = part if gone is None else gone.unionByName(part)
            last = gone.groupBy(F.col(key).alias("_key")).agg(F.max("_until").alias("_until"))
            rows = rows.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_until").isNull() | (F.col("_until") <= F.col("_at"))).drop("_key", "_until")
        return rows.drop("_at")

    def written(self, table: str, prepared: Manifest) -> DataFrame:
        """The rows of the newest segment of a table, as they were prepared."""
        s = prepared.tables[table][-1]
        return self.spark.read.schema(StructType.fromJson(json.loads(s["schema"]))).parquet(f"{self.root}/{s['rows']}")

    # the two phases

    def prepare(self, changes: dict[str, Change], fingerprint: str, facts: dict | None = None) -> Manifest:
        """First phase: writes the segments and gives the manifest that would hold them. Readers see nothing of it."""
        now = self.manifest() or Manifest(0, "")
        number = now.number + 1
        tables = {t: list(s) for t, s in now.tables.items()}
        done: dict[str, DataFrame] = {}
        change = f"segments/{number:012d}-{uuid.uuid4().hex}"
        for name, c in changes.items():
            key, folder = self.keys[name], f"{change}/{name}"
            made = c.rows(done) if callable(c.rows) else c.rows
            rows = made.sortWithinPartitions(*c.sort) if c.sort else made
            with shuffles_dropped(self.spark):
                rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}/rows", partitionBy=list(c.by) or None)
            done[name] = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}/rows")
            gone = None
            if name in now.tables:
                own = done[name].select(key) if c.replaces else None
                keys = own if c.removed is None else c.removed.select(key) if own is None else own.unionByName(c.removed.select(key))
                if keys is not None:
                    with shuffles_dropped(self.spark):
                        keys.distinct().write.option("compression", "zstd").parquet(f"{self.root}/{folder}/gone")
                    gone = f"{folder}/gone"
            tables.setdefault(name, []).append({"number": number, "rows": f"{folder}/rows", "schema": rows.schema.json(), "gone": gone})
        return Manifest(number, fingerprint, tables, (now.facts | facts) if facts else now.facts)

    def activate(self, prepared: Manifest) -> bool:
        """Second phase: one rename. False if another change took the number first; what was prepared then has to be made anew."""
        aside, name = f"aside-{uuid.uuid4().hex}", f"{prepared.number:012d}.json"
        self.fs.mkdirs(self._at("manifests"))
        self._put(json.dumps(prepared.__dict__), aside)
        if self.fs.exists(self._at("manifests", name)) or not self.fs.rename(self._at(aside), self._at("manifests", name)):
            self.fs.delete(self._at(aside), False)
            return False
        return True

    def commit(self, changes: dict[str, Change], fingerprint: str, facts: dict | None = None) -> bool:
        """Both phases. True if something was written; a change with the fingerprint of the present state writes nothing."""
        now = self.manifest()
        if now is not None and now.fingerprint == fingerprint:
            return False
        if not self.activate(self.prepare(changes, fingerprint, facts)):
            raise RuntimeError("another change was committed meanwhile")
        return True

    # housekeeping, by one writer

    def _held(self, manifests: list[str]) -> set[str]:
        tables = [json.loads(self._text("manifests", n))["tables"] for n in manifests]
        return {s[k].split("/")[1] for t in tables for parts in t.values() for s in parts for k in ("rows", "gone") if s[k]}

    def repair(self) -> list[str]:
        """Deletes what no manifest names: segments and manifests set aside of changes that ended between the phases."""
        held = self._held(self._names("manifests"))
        lost = [("segments", n) for n in self._names("segments") if n not in held] + [(n,) for n in self._names() if n.startswith("aside-")]
        for parts in lost:
            self.fs.delete(self._at(*parts), True)
        return ["/".join(p) for p in lost]

    def compact(self, table: str, by: tuple[str, ...] = (), sort: tuple[str, ...] = (), most: int = MOST_SEGMENTS) -> bool:
        """Rewrites a table as one segment once it has more than `most`; the rows stay the same."""
        now = self.manifest()
        if now is None or len(now.tables.get(table, [])) <= most:
            return False
        ahead = self.prepare({table: Change(self.read(table, now), by=by, sort=sort, replaces=False)}, now.fingerprint)
        ahead.tables[table] = ahead.tables[table][-1:]
        return self.activate(ahead)

    def forget(self, keep: int = 2) -> list[str]:
        """Deletes all manifests but the newest `keep`, then the segments that no manifest names any more."""
        for name in self._names("manifests")[: -max(1, keep)]:
            self.fs.delete(self._at("manifests", name), False)
        return self.repair()
