"""Operator 11: draw documents by importance towards a target's word features (hashed n-grams, Gumbel noise).

Identical texts are collapsed by grouping their full text; the histogram of buckets is made once a distinct text and stored, counts
are multiplied by the number of copies, and the weight is summed once a distinct text. Weights are joined back to documents by the
SHA-256 of the text before the noise, which hangs on the document's id alone. What is learned of the corpus is one counter a
bucket. The draw is a range sort: places are told from sums of ranges, so no task sees more than a range.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import as_bytes, join_back, kept, materialise, slices
from palimpsest.llm._words import pieces
from palimpsest.operators.ranges import running

BUCKETS = 10_000
#: ASCII letters in lower case; every other ASCII character but digits parts words.
_AS_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
#: Distinct words that a worker remembers between pieces of text.
_REMEMBERED = 500_000


class _Buckets(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def text_features(text: bytes, n: int, buckets: int) -> tuple[np.ndarray, int]:
    """Buckets of all runs of 1 to n words, repeats included, as (bucket, count) columns, and the number of words.

    A long text is taken in pieces cut between words; the last n - 1 words of a piece are carried into the next."""
    bucket = kept(("importance", buckets), lambda: _Buckets(buckets))
    sums, total, tail = None, 0, []
    for piece in pieces(text):
        if len(bucket) > _REMEMBERED:
            bucket.clear()
        words = piece.translate(_AS_WORDS).split()
        found = np.fromiter(map(bucket.__getitem__, words), np.int64, len(words))
        total += len(words)
        if n > 1:
            run = tail + words
            grams = [zlib.crc32(b" ".join(run[i : i + k])) % buckets for k in range(2, n + 1) for i in range(max(0, len(tail) - k + 1), len(run) - k + 1)]
            found = np.concatenate([found, np.array(grams, np.int64)])
            tail = run[-(n - 1) :]
        at, count = np.unique(found, return_counts=True)
        if sums is None:
            sums = at, count
        else:
            both, where = np.unique(np.concatenate([sums[0], at]), return_inverse=True)
            sums = both, np.bincount(where, np.concatenate([sums[1], count])).astype(np.int64)
    return np.stack(sums, 1), total


_FEATURES = "key binary, copies long, n_words long, n_features long, buckets array<int>, counts array<long>"


def features(docs: DataFrame, n: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """A row for each distinct text: its SHA-256, how many documents have it, its words and features, and its histogram. Null is empty."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def measured(batches):
        for s in slices(batches, "text"):
            texts = as_bytes(s.column("text"))
            found = [text_features(t, n, buckets) for t in texts]
            histograms = np.concatenate([h for h, _ in found]) if found else np.empty((0, 2), np.int64)
            ends = np.concatenate([[0], np.cumsum([len(h) for h, _ in found])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(histograms[:, k].astype(kind))) for k, kind in ((0, np.int32), (1, np.int64))]
            sums = pa.array([int(h[:, 1].sum()) for h, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), s.column("copies"), pa.array([w for _, w in found], pa.int64()), sums, *lists], ["key", "copies", "n_words", "n_features", "buckets", "counts"])

    return texts.mapInArrow(measured, _FEATURES)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the histograms in a batch."""
    lists = batch.column("buckets")
    lengths = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    return np.repeat(np.arange(batch.num_rows), lengths), np.asarray(lists.flatten()), np.asarray(batch.column("counts").flatten())


def bucket_totals(feats: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often all documents have it, copies counted. Each task adds its own first, one counter a bucket."""

    def added(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            row, bucket, count = _flat(b)
            np.add.at(sums, bucket, count * np.asarray(b.column("copies"))[row])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])

    return feats.select("copies", "buckets", "counts").mapInArrow(added, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths: how much likelier the target has it, with one added to each counter."""
    a, b = source.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(a, "bucket", "left").join(b, "bucket", "left").fillna(0)
    all_s, all_t = (both.agg(F.sum(c)).first()[0] for c in "st")
    gain = F.floor(1000 * F.log((F.col("t") + 1.0) * (all_s + float(buckets)) / ((F.col("s") + 1.0) * (all_t + float(buckets)))))
    found = both.select("bucket", gain.alias("gain")).toPandas()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["gain"].to_numpy()
    return out


def weigh(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """The weight of each distinct text: the sum of its features' gains."""

    def summed(batches):
        for b in batches:
            row, bucket, count = _flat(b)
            sums = np.zeros(b.num_rows, np.int64)
            np.add.at(sums, row, gain[bucket] * count)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), b.column("n_words"), b.column("n_features"), pa.array(sums)], ["key", "copies", "n_words", "n_features", "weight"])

    return feats.mapInArrow(summed, "key binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, buckets: int = BUCKETS, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Every document's id, n_features, weight, score and rank: the highest scores of `percent` of those with least_words words.

    Null texts count as empty, with weight 0 and no rank. Ties go to the smaller id; repeated ids are drawn one by one, and rows equal
    in all columns in any order. Empty tables are no error: without documents there are no rows, without a target every bucket has
    the target's prior. Columns of docs other than id and text are not read.
    """
    feats = materialise(features(docs, n, buckets, text_col), "features")
    wanted = features(target, n, buckets, target_text_col)
    weighed = materialise(weigh(feats, gains(bucket_totals(feats, buckets), bucket_totals(wanted, buckets), buckets)), "weights")
    keyed = materialise(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("key")), "keys")
    known = join_back(keyed, weighed, "key", "copies", keyed.count()).drop("key", "copies")
    scored = materialise(known.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")

    able = F.col("n_words") >= least_words
    drawn = percent * scored.filter(able).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    ranked = running(scored.filter(able), order, {}, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")
