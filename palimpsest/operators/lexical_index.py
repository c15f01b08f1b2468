"""A stored index for BM25 over words that hold a term, with block bounds.

A term is a piece of text without blanks, so it lies within a word (a run without blanks) of a column. The dictionary has each
distinct word once, and a list of trigrams leads to the words that hold a term. Chunks are dealt over blocks by their length;
postings (word, block, key) carry the weighted count and the chunk's length, and a header for each word and block the greatest
count and how many chunks. The number of chunks and the sum of their lengths are facts of the manifest.

A search finds the words of its terms, then bounds each block's best score from headers; blocks without one of the terms are out.
The best few blocks are scored first, and their k-th score shuts out all blocks that cannot reach it. Postings lie in folders by word,
sorted, so a search reads those of its words. Nothing scans the chunks.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions.textfns import occurrences
from palimpsest.operators.projection import Change, Projection
from palimpsest.operators.ranges import range_count
from palimpsest.operators.search import K1, WEIGHTS, B
from palimpsest.operators.stored import discard, store

#: Folders of postings and of trigrams, by a hash of the word or trigram.
FOLDERS = 16
#: Chunks of a block, and blocks that are scored before the others are bounded.
BLOCK_CHUNKS, FIRST_BLOCKS = 256, 8
#: Letters of chunks whose postings a task sorts and writes, a file a folder, about.
TASK_LETTERS = 1 << 25
#: Letters whose words a task counts at once, about; a chunk is not parted.
COUNTED_LETTERS = 1 << 22
#: Keys of replaced and removed chunks that are broadcast to find their postings; more are joined.
BROADCAST_KEYS = 1 << 21
#: Words of a term that go into the filter of a scan; with more, the folders alone are pruned and words are joined.
NAMED_WORDS = 500


def _folder(c: Column) -> Column:
    return (F.crc32(c.cast("binary")) % FOLDERS).cast("int")


def _three(word: Column) -> Column:
    """Distinct trigrams of a word, from its array of characters."""
    signs = F.split(word, "")
    n = F.greatest(F.size(signs) - 2, F.lit(0))
    joined = lambda a, b: F.concat(a, b)
    three = F.zip_with(F.zip_with(F.slice(signs, 1, n), F.slice(signs, 2, n), joined), F.slice(signs, 3, n), joined)
    return F.array_distinct(F.filter(three, lambda g: F.length(g) == 3))


def _block(bounds: np.ndarray, length: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The range that a length falls in; a length that several bounds have is dealt over their ranges."""
    low, high = np.searchsorted(bounds, length, "left"), np.searchsorted(bounds, length, "right")
    return low + mix % (high - low + 1)


def _posted(key: str, bounds: list[int], base: int):
    """Gives the postings of batches of (key, length, _mix, columns in lower case) in the order of folders, words and blocks, so that
    sorting a task's rows finds long runs. Words are parted by blanks of any kind."""

    def posted(batches):
        limits = np.array(bounds, np.int64)
        for whole in batches:
            ends, first = np.cumsum(whole.column("length").to_numpy() + 1), 0
            while first < whole.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COUNTED_LETTERS, "right")))
                b, n, first = whole.slice(first, last - first), last - first, last
                length = b.column("length").to_numpy()
                block = base + _block(limits, length, b.column("_mix").to_numpy())
                lists = [pc.utf8_split_whitespace(b.column(c)) for c in WEIGHTS]
                sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists])
                parted = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                words, codes = parted.dictionary, parted.indices.to_numpy()
                turn = np.argsort(block, kind="stable")
                place = np.empty(n, np.int64)
                place[turn] = np.arange(n)
                folder = pa.array([zlib.crc32(w) % FOLDERS for w in words.cast(pa.binary()).to_pylist()], pa.int32())
                told = pa.table({"folder": folder, "word": words})
                order = pc.sort_indices(told, sort_keys=[("folder", "ascending"), ("word", "ascending")])
                rank = np.empty(len(words), np.int64)
                rank[order.to_numpy()] = np.arange(len(words))
                at = rank[codes] * n + np.repeat(np.tile(place, len(lists)), sizes)
                weights = np.repeat(np.repeat(list(WEIGHTS.values()), n), sizes)
                held = np.isin(codes, pc.index(words, pa.scalar("", words.type)).as_py(), invert=True)  # what stands before and behind blanks
                at, weights = at[held], weights[held]
                if not len(at):
                    continue
                sorting = np.argsort(at)
                at = at[sorting]
                begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                row = turn[at[begins] % n]
                told = told.take(order.take(pa.array(at[begins] // n))).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [told["word"].combine_chunks(), told["folder"].combine_chunks(), pa.array(block[row]), b.column(key).take(pa.array(row)), pa.array(length[row]), pa.array(np.add.reduceat(weights[sorting], begins))],
                    ["word", "folder", "block", key, "length", "tf"],
                )

    return posted


class LexicalIndex:
    """An index of chunks: key, the searched columns (title, heading, text, tags) and payload columns that searches filter by."""

    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id", payload: tuple[str, ...] = ()):
        self.spark, self.key, self.payload = spark, key, payload
        self.store = Projection(spark, root, {"docs": key, "postings": key, "headers": "word", "grams": "word"})

    # writing

    def commit(self, chunks: DataFrame, fingerprint: str, removed: DataFrame | None = None) -> bool:
        """Adds chunks in place of those of the same key, and takes out the keys in removed; all tables change at once, or, if
        the index stands for the fingerprint, none. removed needs the key only. What goes is counted back from its own postings. Chunks
        are read once a table and not written, so they must be the same rows each time they are read."""
        now = self.store.manifest()
        if now is not None and now.fingerprint == fingerprint:
            return False
        length = reduce(lambda a, b: a + b, (F.greatest(F.length(F.coalesce(c, F.lit(""))) - 2, F.lit(0)) for c in WEIGHTS)).cast("long")
        base = (now.number + 1 if now else 1) * (1 << 32)
        counts = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")]
        lengths = store(chunks.select(length.alias("length")), "lengths")
        sums = lengths.agg(*counts).first()
        ranges = range_count(sums.n, int(self.spark.conf.get("spark.sql.shuffle.partitions")), BLOCK_CHUNKS, BLOCK_CHUNKS * 256)
        shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
        bounds = sorted(lengths.agg(F.percentile_approx("length", shares, max(10_000, 10 * ranges))).first()[0] or []) if ranges > 1 else []
        discard(lengths)
        mixed = chunks.select(self.key, length.alias("length"), F.pmod(F.xxhash64(self.key), F.lit(1 << 31)).alias("_mix"), *(F.lower(c).alias(c) for c in WEIGHTS))
        told = chunks.select(self.key, length.alias("length"), F.pmod(F.xxhash64(self.key), F.lit(1 << 31)).alias("block"), *self.payload)
        kind = chunks.select(self.key).schema[0].dataType.simpleString()

        def dealt(batches):
            for b in batches:
                block = base + _block(np.array(bounds, np.int64), b.column("length").to_numpy(), b.column("block").to_numpy())
                yield b.set_column(b.schema.get_field_index("block"), "block", pa.array(block))

        docs = told.mapInArrow(dealt, StructType([*told.schema.fields]))
        tasks = max(2 * self.spark.sparkContext.defaultParallelism, sums.total // TASK_LETTERS)
        posted = mixed.repartition(tasks, self.key).mapInArrow(_posted(self.key, bounds, base), f"word string, folder int, block long, `{self.key}` {kind}, length long, tf double")
        # counts that leave the index: the living postings and documents of every key that is replaced or removed
        keys = None
        if now:
            own = chunks.select(self.key)
            keys = store((own if removed is None else own.unionByName(removed.select(self.key))).distinct(), "keys")
            sent = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
            old = self.store.read("postings", now).join(sent, self.key, "left_semi").groupBy("word", "block").agg((-F.count(F.lit(1))).alias("n")).withColumns({"most": F.lit(0.0), "shortest": F.lit(None).cast("long")})
            gone = self.store.read("docs", now).join(sent, self.key, "left_semi").agg(*counts).first()
        facts = {"n": sums.n, "total": sums.total}
        if now:
            facts = {k: now.facts[k] + facts[k] - gone[k] for k in facts}
        foldered = lambda df: df.withColumn("folder", _folder(F.col("word")))

        def headers(done: dict[str, DataFrame]) -> DataFrame:
            new = done["postings"].groupBy("word", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("shortest"))
            return foldered(new.unionByName(old) if now else new)

        def grams(done: dict[str, DataFrame]) -> DataFrame:
            known = done["headers"].select("word").distinct()
            if now:
                known = known.join(self.store.read("headers", now).select("word").distinct(), "word", "left_anti")
            return known.select("word", F.explode(_three("word")).alias("gram")).withColumn("folder", _folder(F.col("gram")))

        changes = {
            "docs": Change(docs, removed, sort=("block",)),
            "postings": Change(posted, keys, by=("folder",), sort=("folder", "word", "block"), replaces=False),
            "headers": Change(headers, by=("folder",), sort=("folder", "word", "block"), replaces=False),
            "grams": Change(grams, by=("folder",), sort=("folder", "gram"), replaces=False),
        }
        written = self.store.commit(changes, fingerprint, facts)
        if keys is not None:
            discard(keys)
        return written

    # reading

    def words(self, terms: list[str]) -> DataFrame:
        """(term, word, times): the words that hold a term, and how often, overlaps included. Terms are in lower case."""
        grams = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
        held = self.store.read("grams").filter(F.col("folder").isin(sorted({zlib.crc32(g.encode()) % FOLDERS for g in grams})) & F.col("gram").isin(grams))
        out = None
        for i, t in enumerate(terms):
            own = sorted({t[i : i + 3] for i in range(len(t) - 2)})
            of = held.filter(F.col("gram").isin(own)).groupBy("word").agg(F.count_distinct("gram").alias("_g")).filter(F.col("_g") == len(own)).select("word")
            told = of.filter(F.contains("word", F.lit(t))).select(F.lit(i).alias("term"), "word", occurrences(F.col("word"), t, lowered=True).alias("times"))
            out = told if out is None else out.unionByName(told)
        return out

    def search(self, terms: list[str], limit: int, allowed: Column | None = None) -> list[Row]:
        """Rows (key, bm25) of the chunks that hold every term, best first, ties by key, as many as wanted.

        allowed is a condition on payload columns; statistics are of all chunks. Terms under three characters, with blanks in
        them, or none at all match nothing here.
        """
        low = [t.lower() for t in terms]
        if not low or min(map(len, low)) < 3 or any(len(t.split()) != 1 for t in low):
            return []
        found = self.words(low).withColumn("folder", _folder(F.col("word"))).limit(NAMED_WORDS + 1).collect()
        named = len(found) <= NAMED_WORDS
        if named and {r.term for r in found} != set(range(len(low))):
            return []
        if named:
            words = self.spark.createDataFrame([(r.term, r.word, r.times) for r in found], "term int, word string, times int")
            among = F.col("folder").isin(sorted({r.folder for r in found})) & F.col("word").isin(sorted({r.word for r in found}))
        else:
            words, among = self.words(low), F.lit(True)
        total = self.store.manifest().facts
        headers = self.store.read("headers").filter(among).join(words, "word")
        postings = self.store.read("postings").filter(among).join(words, "word")
        single = [i for i in range(len(low)) if named and sum(r.term == i for r in found) == 1]
        each = [F.sum(F.when(F.col("term") == i, F.col("most") * F.col("times"))).alias(f"m{i}") for i in range(len(low))]
        here = [F.sum(F.when(F.col("term") == i, F.col("n"))).alias(f"n{i}") for i in range(len(low))]
        by_block = headers.groupBy("block").agg(*each, *here, F.min("shortest").alias("shortest"))
        # how many chunks hold a term: headers count the chunks of a word, but a chunk may hold several words of a term
        held = by_block.agg(*(F.sum(f"n{i}").alias(f"df{i}") for i in single), F.lit(0).alias("_one"))
        many = [i for i in range(len(low)) if i not in single]
        if many:
            distinct = postings.filter(F.col("term").isin(many)).groupBy("term", self.key).count().groupBy().agg(*(F.count_if(F.col("term") == i).alias(f"df{i}") for i in many))
            held = held.crossJoin(distinct)
        scored = lambda df, tf, size: reduce(lambda a, b: a + b, [_part(total["n"], df(i), tf(i), size, total["total"] / total["n"]) for i in range(len(low))], F.lit(0.0))

        full = by_block.filter(reduce(lambda a, b: a & b, [F.col(f"n{i}") > 0 for i in range(len(low))]))
        bounded = lambda df: scored(df, lambda i: F.col(f"m{i}"), F.col("shortest"))
        told = full.crossJoin(F.broadcast(held)).withColumn("bound", bounded(lambda i: F.col(f"df{i}"))).orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()
        if not told:
            return []
        first, df = [r.block for r in told], [told[0][f"df{i}"] for i in range(len(low))]
        total_of = lambda tf, size: scored(lambda i: F.lit(df[i]), tf, size)
        best = self._score(postings.filter(F.col("block").isin(first)), low, total_of, limit, allowed)
        if len(first) < FIRST_BLOCKS:
            return best
        least = -best[-1].bm25 if len(best) == limit else 0.0
        rest = full.filter((bounded(lambda i: F.lit(df[i])) >= least - 1e-9) & ~F.col("block").isin(first)).select("block")
        also = self._score(postings.join(rest, "block", "left_semi"), low, total_of, limit, allowed)
        return sorted(best + also, key=lambda r: (r.bm25, r[self.key]))[:limit]

    def _score(self, postings: DataFrame, low: list[str], scored, limit: int, allowed: Column | None) -> list[Row]:
        each = [F.sum(F.when(F.col("term") == i, F.col("tf") * F.col("times"))).alias(f"t{i}") for i in range(len(low))]
        hits = postings.groupBy(self.key, "length").agg(*each).filter(reduce(lambda a, b: a & b, [F.col(f"t{i}").isNotNull() for i in range(len(low))]))
        if allowed is not None:
            hits = hits.join(self.store.read("docs").filter(allowed).select(self.key), self.key, "left_semi")
        return hits.select(self.key, (-scored(lambda i: F.col(f"t{i}"), F.col("length"))).alias("bm25")).orderBy("bm25", self.key).limit(limit).collect()


def _part(n: int, df: Column, tf: Column, size: Column, average: float) -> Column:
    """The score of one term, in the order of operations of search.lexical."""
    raw = F.log((F.lit(n) - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, 1e-6).otherwise(raw) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(average)))
