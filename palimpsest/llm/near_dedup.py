"""Operator 2: near-duplicate classes by ProbMinHash over five-word shingles, banding and exact verification.

Each distinct shingle of a text is a Poisson process whose rate is its weight. Links are told by sets of shingles, so all weigh 1,
however often a text repeats them. Arrivals fall on random slots; a
slot keeps the shingle that arrives first. Arrivals are made in rounds, and a shingle leaves as soon as its next arrival is
later than the latest first arrival of all slots, so long texts need little more than one arrival a shingle. Two texts agree
on a slot with the probability Jaccard of their weighted shingles, which is the plain Jaccard where weights are equal.

Texts that agree on all slots of a band share a bucket. In a bucket of up to FEW texts all pairs are candidates. In a larger one
pairs are made with one pivot a round: first the member that meets the most others over all its buckets, which is the text that
the others are copies of, then the best and later a random one of those outside the bucket's main class, against all of other
classes. Pairs that pass an exact length bound are verified on their shingle sets; verified links make classes, and rounds go
on while one links more than a tenth of the texts that are left. A round costs about n pairs in a bucket of n texts. Pivots only
save work: buckets that still hold several classes are then settled by an exact prefix-filter join of all their texts. Two texts
of n and m shingles can only reach the threshold t if they share one of the first n - ceil(t n) + 1 and m - ceil(t m) + 1 of
their shingles in any one order, here rare ones first, so every such pair of two classes is met and verified. Equal texts are
one node throughout. With 24 bands of 4 slots a pair at 0.8 misses all bands with probability 3e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.llm._shared import as_bytes, forget, materialise, slices
from palimpsest.llm._words import hashed, mixed, runs

BANDS, ROWS = 24, 4
#: Texts of a bucket whose pairs are all candidates.
FEW = 6
SHINGLE = 5
#: Pivot rounds go on while one links this share of the texts in open buckets.
WORTH = 0.1
#: Counters that order shingles from rare to common; one holds the shingles of one remainder.
CELLS = 1 << 20
#: Rows of one key, a bucket, a pivot or a shingle outside its main class, that one task compares with the others.
SALTED = 1024
_TO_UNIT = 2.0**-53
_GOLDEN = 0x9E3779B97F4A7C15


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, occurrences) of each distinct shingle, by text; a shorter text is one shingle of all its words."""
    words, lengths = hashed(texts)
    ends = np.cumsum(lengths)
    first = ends - lengths
    owners, values = [], []
    for n in range(1, size + 1):
        chosen = np.flatnonzero(lengths == n if n < size else lengths >= size)
        if not len(chosen):
            continue
        (grams,) = runs(words, n)
        count = lengths[chosen] - n + 1
        owner = np.repeat(chosen, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        owners.append(owner)
        values.append(grams[at])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
    return owner[new], value[new], np.diff(np.append(new, len(owner)))


def probminhash(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """One row of `slots` shingle hashes for each text; texts without shingles have zeros."""
    best = np.full(texts * slots, np.inf)
    out = np.zeros(texts * slots, np.uint64)
    time = np.zeros(len(owner))
    at = np.arange(len(owner))
    turn = 0
    while len(at):
        turn += 1
        draw = mixed(value[at] + np.uint64(turn * _GOLDEN % (1 << 64)))
        time[at] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * _TO_UNIT) / weight[at]
        slot = owner[at] * slots + (mixed(draw) % np.uint64(slots)).astype(np.int64)
        now = time[at]
        if turn > 1:
            live = now < best.reshape(texts, slots).max(axis=1)[owner[at]]
            at, slot, now = at[live], slot[live], now[live]
        np.minimum.at(best, slot, now)
        won = now == best[slot]
        out[slot[won]] = value[at[won]]
        at = at[time[at] < best.reshape(texts, slots).max(axis=1)[owner[at]]]
    return out.reshape(texts, slots)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, node, n_shingles, bands) of every row: node is the MD5 of the text, bands one hash for each band."""

    def made(batches):
        for s in slices(batches, text_col):
            owner, value, _ = shingles(as_bytes(s.column(text_col)))
            slots = probminhash(owner, value, np.ones(len(owner)), s.num_rows, bands * rows).reshape(-1, rows)
            acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64), s.num_rows)
            for k in range(rows):
                acc = mixed(acc * np.uint64(_GOLDEN) + slots[:, k])
            offsets = pa.array(np.arange(s.num_rows + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([s.column("_id"), s.column("node"), pa.array(np.bincount(owner, minlength=s.num_rows)), pa.ListArray.from_arrays(offsets, pa.array(acc.view(np.int64)))], ["_id", "node", "n_shingles", "bands"])

    read = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("node"), text_col)
    return read.mapInArrow(made, f"_id {docs.schema[id_col].dataType.simpleString()}, node binary, n_shingles long, bands array<long>")


def _sets(texts: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles): the hash of each distinct shingle."""

    def made(batches):
        for s in slices(batches, text_col):
            owner, value, _ = shingles(as_bytes(s.column(text_col)))
            offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=s.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([s.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))], ["node", "shingles"])

    return texts.select("node", text_col).mapInArrow(made, "node binary, shingles array<long>")


def _prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, class, n, place, shingle): the rarest of each node's n shingles, one of which any text as like as `threshold` shares."""
    counted = rows.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(CELLS)).alias("cell")).count().toArrow()
    loads = np.zeros(CELLS, np.int64)
    loads[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(loads)

    def made(batches):
        for batch in batches:
            values = batch.column("shingles").flatten().to_numpy()
            sizes = pc.list_value_length(batch.column("shingles")).to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, shared.value[(values.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)], owner))
            place, n = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
            at = np.flatnonzero(place <= n - np.ceil(threshold * n - 1e-9))
            whose = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(whose), batch.column("class").take(whose), pa.array(n[at], pa.int32()), pa.array(place[at], pa.int32()), pa.array(values[order][at], pa.int64())], ["node", "class", "n", "place", "shingle"])

    return rows.select("node", "class", "shingles").mapInArrow(made, "node binary, class binary, n int, place int, shingle long")


def _settled(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, n, b, n_p, salts): all pairs of nodes of different classes that may be as like as `threshold`, some more than once.

    In each shingle's group those outside its largest class meet all; they are dealt over tasks by salts.
    """
    held = materialise(_prefixes(rows, threshold), "prefixes")
    counted = held.groupBy("shingle", "class").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.count("*").alias("classes"), (F.sum("k") - F.max("k")).alias("others"))
    groups = counted.filter("classes > 1").select("shingle", "main", F.ceil(F.col("others") / SALTED).cast("int").alias("salts"))
    met = held.join(groups, "shingle")
    every = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    other = met.filter("class <> main").select("shingle", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.col("node").alias("b"), F.col("class").alias("class_p"), F.col("n").alias("n_p"), F.col("place").alias("place_p"))
    once = (F.col("class") == F.col("main")) | (F.col("node") < F.col("b"))
    fits = F.least(F.col("n") - F.col("place"), F.col("n_p") - F.col("place_p")) >= threshold / (1 + threshold) * (F.col("n") + F.col("n_p")) - 1e-6
    on = (every["shingle"] == other["shingle"]) & (every["salt"] == other["salt"]) & (F.col("class") != F.col("class_p")) & once & fits
    return every.hint("merge").join(other, on).select(F.col("node").alias("a"), "n", "b", "n_p", F.lit(1).alias("salts"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class) of every node in links: class is the least node that it is connected with.

    Alternating large-star and small-star steps over edges. The least neighbour of a node is aggregated with map-side combine
    and joined back, so that adaptive execution can split a node of very many edges. A step is written to the shared folder
    and the one before it deleted; steps go on until one changes nothing.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        before, edges = edges, materialise(kept.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        forget(before)
        if seen.get == state:
            break
        state = seen.get
    return edges.groupBy("u").agg(F.min("v").alias("class")).select(F.col("u").alias("node"), "class").union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_in_class, keep) of every row of docs.

    A class holds the rows that links connect; two different texts are linked if the Jaccard similarity of their sets of
    five-word shingles (words unchanged) is at least `threshold`. Equal texts, empty ones too, are always one class. class_id is
    its least id, and keep marks one row of each class: the least id, of equal rows any one. A null text is a class of its own:
    class_id is its id. Null ids come last; a class of null ids only has a null class_id. Other columns are not read; an empty
    table gives an empty result.
    """
    texts = docs.filter(F.col(text_col).isNotNull())
    sketched = materialise(sketch(texts, id_col, text_col, bands, rows), "sketch")
    nodes = sketched.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).filter("n > 0")
    exploded = nodes.select("node", "n", F.posexplode("bands").alias("band", "h")).select("node", "n", F.xxhash64("band", "h").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    sized = materialise(exploded.join(shared, "key"), "sized")
    degrees = sized.groupBy("node").agg(F.sum("size").alias("degree"))
    members = materialise(sized.join(degrees, "node"), "members")
    told = texts.select(F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("node"), text_col)
    sets = materialise(_sets(told.join(members.select("node").distinct(), "node", "left_semi"), text_col).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, n, b, n_p, salts). Pairs of one b, as those with a pivot are, are dealt over its salts."""
        fits = pairs.filter(F.least("n", "n_p") >= threshold * F.greatest("n", "n_p")).filter("a <> b")
        once = fits.groupBy("a", "b").agg(F.max("salts").alias("salts")).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
        copies = once.groupBy("b").agg(F.max("salts").alias("salts")).withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int")))).drop("salts")
        left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        met = once.drop("salts").join(left, "a").join(copies.join(right, "b"), ["b", "salt"]).withColumn("both", F.size(F.array_intersect("x", "y")))
        return materialise(met.filter(F.col("both") >= threshold * (F.size("x") + F.size("y") - F.col("both"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    def by_key(rows: DataFrame, told: DataFrame) -> DataFrame:
        """rows joined with one row for each bucket, which is copied to as many salts as its members are dealt over."""
        salts = F.ceil(F.col("size") / SALTED).cast("int")
        return rows.withColumn("_s", F.pmod(F.xxhash64("node"), salts).cast("int")).join(told.withColumn("_s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("size"), ["key", "_s"]).drop("_s")

    few = members.filter(F.col("size") <= FEW).select("key", F.col("node").alias("a"), "n")
    pairs = few.join(few.toDF("key", "b", "n_p"), "key").filter("a < b").select("a", "n", "b", "n_p", F.lit(1).alias("salts"))
    many = members.filter(F.col("size") > FEW).select("key", "node", "n", "degree", "size")
    first = lambda *more: (F.max(F.struct(*more, "degree", "node", "n", "class")).alias("p"), F.max("size").alias("size"))

    def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
        ends = links
        for e in ("a", "b"):
            ends = ends.join(classes.toDF(e, f"class_{e}"), e, "left").withColumn(f"class_{e}", F.coalesce(f"class_{e}", e))
        roots = components(ends, "class_a", "class_b").toDF("class", "root")
        known = classes.union(links.select("a", "a").union(links.select("b", "b")).distinct().toDF("node", "class").join(classes.select("node"), "node", "left_anti"))
        return materialise(known.join(roots, "class", "left").select("node", F.coalesce("root", "class").alias("class")), "classes")

    classes, turn, mine = None, 0, many.withColumn("class", F.col("node"))
    while True:
        leads = mine.groupBy("key").agg(*first())
        if turn:
            mains = mine.groupBy("key", "class").agg(F.count("*").alias("k"), F.max("size").alias("size")).groupBy("key").agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.count("*").alias("classes"), F.max("size").alias("size"))
            mine = materialise(by_key(mine, mains.filter("classes > 1").drop("classes")), "open")
            leads = mine.filter("class <> main").groupBy("key").agg(*first(*([F.xxhash64("node", F.lit(turn)).alias("order")] if turn > 1 else [])))
        met = by_key(mine, leads).filter("class <> p.class").select(F.col("node").alias("a"), "n", F.col("p.node").alias("b"), F.col("p.n").alias("n_p"), F.ceil(F.col("size") / SALTED).cast("int").alias("salts"))
        links = verified(met if turn else met.union(pairs))
        found = links.count() if turn else 1
        if found:
            classes = joined(classes, links) if turn else materialise(components(links), "classes")
        if turn and found <= WORTH * mine.count():
            break
        turn += 1
        mine = many.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    left = mine.select("node").distinct().join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    if not left.isEmpty():
        links = verified(_settled(sets.join(left, "node"), threshold))
        if not links.isEmpty():
            classes = joined(classes, links)
    numbered = materialise(sketched.select("_id", "node").join(classes, "node", "left").select("_id", F.coalesce("class", "node").alias("class"), F.monotonically_increasing_id().alias("_row")), "rows")
    sized = numbered.groupBy("class").agg(F.min("_id").alias("class_id"), F.count("*").alias("n_in_class"), F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_row"))["_row"].alias("_kept"))
    out = numbered.join(sized, "class").select(F.col("_id").alias(id_col), "class_id", "n_in_class", (F.col("_row") == F.col("_kept")).alias("keep"))
    alone = docs.filter(F.col(text_col).isNull()).select(id_col, F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("n_in_class"), F.lit(True).alias("keep"))
    return out.unionByName(alone)
