"""An inverted file of vectors: cells of a bounded k-means, vectors stored by cell, search in the nearest cells.

Cells are told from a sample of a stated size; every vector is stored in the cell of its nearest centre, with the payload that
searches filter by. A search reads the centres, one row a cell, and then only the folders of the cells it probes; filters come
before the top-k, and scores are made from the stored vectors, so what is found has the scores of a full scan. Each cell keeps
how far its vectors lie from the centre, at most and on average. The most bounds what a vector in it can score: a proving search
goes on until no cell left can hold one of the k best. The average tells what is likely: an offset from the centre is about
orthogonal to the query, by 1 / sqrt(dimension) give or take, so a search ends where a vector of the next cell would have to lie
several such deviations towards the query. Where vectors do not cluster, both read most cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.projection import Change, Projection
from palimpsest.operators.search import similarity

#: Sampled vectors of a cell, and cells at most: the sample that reaches the driver has no more than their product.
SAMPLE_PER_CELL, MOST_CELLS = 64, 1024
ROUNDS = 8
#: Rows of one file of a cell, about; a large cell has several.
FILE_ROWS = 1 << 18
#: Cells of the first step of a search.
FIRST_CELLS = 8
#: Deviations that a vector may lie towards a query beyond its cell's average before a search misses it.
DEVIATIONS = 3.0
#: What rounding may add to a score.
SLACK = 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; zero vectors stay."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds on unit vectors, from evenly spread rows; an empty cell keeps its centre."""
    points = _unit(sample)
    found = points[np.linspace(0, len(points) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = _nearest(points, found)[0]
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=cells)[:, None]
        found = np.divide(sums, n, out=found.copy(), where=n > 0)
    return found


def _nearest(points: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the distance."""
    square = (points**2).sum(1)[:, None] - 2 * points @ found.T + (found**2).sum(1)[None]
    at = square.argmin(1)
    return at, np.linalg.norm(points - found[at], axis=1)


class VectorIndex:
    """Vectors (key, vector, payload columns) of one length, stored by cell."""

    def __init__(self, spark: SparkSession, root: str, key: str = "vec_id", column: str = "embedding"):
        self.spark, self.key, self.column = spark, key, column
        self.store = Projection(spark, root, {"vectors": key})

    def build(self, vectors: DataFrame, fingerprint: str, cells: int | None = None) -> bool:
        """Writes the index unless it stands for the fingerprint already. Null and empty vectors are left out. The number of
        cells is the root of the number of vectors if it is not given, at most MOST_CELLS."""
        now = self.store.manifest()
        if now is not None and now.fingerprint == fingerprint:
            return False
        known = vectors.filter(F.size(self.column) > 0)
        n = known.count()
        cells = max(1, min(cells or math.isqrt(n), n, MOST_CELLS))
        drawn = known.select(self.column, self.key).orderBy(F.xxhash64(self.key), self.key).limit(cells * SAMPLE_PER_CELL).collect()
        middle = centres(np.array([r[0] for r in drawn], float), cells) if drawn else np.zeros((1, 1))
        return self._write(known, middle, fingerprint, n, None)

    def add(self, vectors: DataFrame, fingerprint: str, removed: DataFrame | None = None) -> bool:
        """Adds vectors to the cells that there are, in place of those of the same key; removed holds further keys that go."""
        if self.store.manifest().fingerprint == fingerprint:
            return False
        known = vectors.filter(F.size(self.column) > 0)
        return self._write(known, self._centres()[0], fingerprint, known.count(), removed)

    def _write(self, known: DataFrame, middle: np.ndarray, fingerprint: str, n: int, removed: DataFrame | None) -> bool:
        names, column = known.columns, self.column

        def placed(batches):
            for b in batches:
                lists = b.column(column)
                points = _unit(np.asarray(lists.flatten(), dtype=np.float64).reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, middle.shape[1]))
                cell, far = _nearest(points, middle)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*names, "cell", "_far"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
        dealt = known.mapInArrow(placed, f"{schema}, cell int, _far double")
        files = max(1, n // FILE_ROWS)
        dealt = dealt.repartition("cell", F.pmod(F.xxhash64(self.key), F.lit(files)))
        ahead = self.store.prepare({"vectors": Change(dealt, removed, by=("cell",))}, fingerprint)
        state = ahead.facts if ahead.facts.get("centres") == middle.tolist() else {"centres": middle.tolist(), **{k: [0.0] * len(middle) for k in ("radius", "far", "n")}}
        facts = {k: list(v) for k, v in state.items()}
        for r in self.store.written("vectors", ahead).groupBy("cell").agg(F.max("_far").alias("radius"), F.sum("_far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
            facts["radius"][r.cell] = max(facts["radius"][r.cell], r.radius)
            facts["far"][r.cell] += r.far
            facts["n"][r.cell] += r.n
        ahead.facts = facts
        if not self.store.activate(ahead):
            raise RuntimeError("another change was committed meanwhile")
        return True

    def _centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centres, greatest and average distances, and how many vectors ever came, by cell: facts of the manifest."""
        facts = self.store.manifest().facts
        middle, radius, far, n = (np.array(facts[k]) for k in ("centres", "radius", "far", "n"))
        return middle, radius, far / np.maximum(1, n), n

    def _best(self, cells: list[int], query: list[float], k: int, allowed: Column | None) -> list[Row]:
        rows = self.store.read("vectors").filter(F.col("cell").isin(cells))
        rows = rows.filter(allowed) if allowed is not None else rows
        return rows.select(self.key, similarity(F.col(self.column), query).alias("score")).orderBy(F.desc("score"), self.key).limit(k).collect()

    def search(self, query: list[float], k: int, allowed: Column | None = None, prove: bool = False, most: int | None = None) -> list[Row]:
        """The k nearest vectors by cosine that `allowed` admits, as rows (key, score), best first, ties by key.

        Cells are read by what they may score, in steps that double, until the next one cannot reach the k-th score: likely not,
        or with prove, surely not, so that the result is that of a full scan. Fewer than k rows are found only if there are no
        more, or `most` cells have been read.
        """
        middle, radius, spread, n = self._centres()
        q = _unit(np.array([query], float))[0]
        if middle.shape[1] != len(q):
            return []
        gap = np.linalg.norm(middle - q, axis=1)
        sure = 1 - np.maximum(0, gap - radius) ** 2 / 2
        likely = 1 - (gap**2 + spread**2 - 2 * DEVIATIONS * gap * spread / math.sqrt(len(q))) / 2
        bound = np.minimum(sure, np.inf if prove else likely) if np.any(q) else np.zeros(len(gap))
        order = [int(c) for c in np.lexsort((gap, -bound)) if n[c] > 0]
        order = order if most is None else order[:most]
        found, at, step = [], 0, FIRST_CELLS
        while at < len(order) and (len(found) < k or bound[order[at]] >= found[-1].score - SLACK):
            found += self._best(order[at : at + step], query, k, allowed)
            found = sorted(found, key=lambda r: (-r.score, r[self.key]))[:k]
            at, step = at + step, step * 2
        self.probed = order[:at]
        return found
