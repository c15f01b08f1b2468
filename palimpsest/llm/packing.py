"""Operator 1: best-fit packing of token pieces into sequences by exact complements.

Lengths are integers up to the capacity, so the whole problem is a histogram of at most `capacity` counts, whatever the
number of documents. The driver turns that histogram into patterns (lists of lengths that share a sequence, with how
often each is used): for the longest remaining length it looks up a single length, a pair or a triple whose sum is exactly
the gap, among the lengths still available; where there is none, the longest that fits goes in and the search goes on
with the smaller gap. A pattern is used as often as the counts allow. Executors then number the pieces of each length and
read their sequence and place from the patterns. No piece is moved for that but its length and key.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm._shared import materialise, slices
from palimpsest.llm.tokens import encoder

#: Pieces of one length that are numbered in one task, about.
RANKED_ROWS = 1_000_000
LEAST_SALTS = 64


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, times used) such that every length is used as often as the histogram says.

    Availability is kept as two bit sets, one mirrored, so that the pair sums of a gap are one shift and one AND.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError(f"lengths must be between 1 and {capacity}")
    have = sum(1 << n for n in left)
    mirrored = sum(1 << (capacity - n) for n in left)
    out: list[tuple[list[int], int]] = []

    def pair(gap: int, free: int, back: int, count) -> tuple[int, int] | None:
        sums = free & (back >> (capacity - gap))
        if gap % 2 == 0 and sums >> (gap // 2) & 1 and count(gap // 2) < 2:
            sums &= ~(1 << (gap // 2))
        return (b, gap - b) if (b := sums.bit_length() - 1) > 0 else None

    while left:
        used: Counter[int] = Counter()
        free, back, gap = have, mirrored, capacity
        count = lambda n: left.get(n, 0) - used[n]

        def take(n: int):
            nonlocal free, back, gap
            used[n] += 1
            gap -= n
            if count(n) == 0:
                free &= ~(1 << n)
                back &= ~(1 << (capacity - n))

        take(have.bit_length() - 1)
        while gap and (fits := free & ((1 << (gap + 1)) - 1)):
            if free >> gap & 1:
                take(gap)
                continue
            if two := pair(gap, free, back, count):
                for n in two:
                    take(n)
                continue
            first, rest = 0, fits
            while rest and (a := rest.bit_length() - 1) * 3 >= gap:
                rest ^= 1 << a
                if a < gap - 1:
                    used[a] += 1
                    single = count(a) == 0
                    two = pair(gap - a, free & ~(1 << a) if single else free, back & ~(1 << (capacity - a)) if single else back, count)
                    used[a] -= 1
                    if two:
                        first = a
                        break
            if first:
                for n in (first, *two):
                    take(n)
            else:
                take(fits.bit_length() - 1)
        times = min(left[n] // k for n, k in used.items() if k)
        out.append((sorted(used.elements(), reverse=True), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                have &= ~(1 << n)
                mirrored &= ~(1 << (capacity - n))
    return out


def placements(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run, the sequence of that rank, the offset there.

    Piece number r of a length lies in the run with the last first rank <= r; its sequence is the run's plus the difference.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    base = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((ranks[n], base, offset))
            ranks[n] += times
            offset += n
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of each piece; ids as unsigned 32-bit little-endian bytes, with their checksum.

    A document is its text's ids and then end_id. One longer than the capacity is cut into pieces of that length, of
    which only the first may be shorter. A null text counts as empty: one piece that holds end_id. Repeated rows and null ids
    stay; other columns, whatever their names, are not read; an empty table gives an empty result. with_ids=False leaves the
    ids in the worker, where only their places and checksums are wanted.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def cut(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        for s in slices(batches, text_col):
            row, piece, start, length, crcs, blobs = [], [], [], [], [], []
            for i, ids in enumerate(enc.encode(s.column(text_col))):
                held = np.concatenate([ids, end]).astype("<u4").tobytes()
                n = len(ids) + 1
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    blob = held[4 * a : 4 * b]
                    crcs.append(zlib.crc32(blob))
                    if with_ids:
                        blobs.append(blob)
            told = [s.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crcs))]
            yield pa.RecordBatch.from_arrays([*told, *([pa.array(blobs, pa.binary())] if with_ids else [])], schema.names)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with (id, piece, length); all other columns stay.

    Pieces are first written to the shared folder, for two passes must see the same rows. Ranks: pieces of a length are dealt
    over salts by a hash of their key, numbered within (length, salt), and shifted by the sizes of the salts before; the number
    of salts follows the number of rows, so that no length, however common, meets in one task. Only the histogram, at most
    `capacity` rows, reaches the driver, and only the plan made from it is broadcast. Rows with equal keys get places of their
    own; an empty table gives an empty result; columns named sequence_id, offset or _salt are replaced.
    """
    spark = pieces.sparkSession
    held = materialise(pieces.drop("sequence_id", "offset", "_salt"), "pieces")
    histogram = dict(held.groupBy("length").count().collect())
    plan = spark.sparkContext.broadcast(placements(plan_patterns(histogram, capacity)))
    salts = max(LEAST_SALTS, -(-sum(histogram.values()) // RANKED_ROWS))
    salted = held.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    group = Window.partitionBy("length", "_salt")
    sizes = salted.groupBy("length", "_salt").count()
    shift = sizes.withColumn("_shift", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("_rank", F.row_number().over(group.orderBy(id_col, "piece")) - 1).join(shift, ["length", "_salt"])
    ranked = ranked.select(*held.columns, (F.col("_rank") + F.col("_shift")).alias("_rank"))
    names = held.columns
    schema = T.StructType([*held.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first, base, place = plan.value[int(n)]
                at = np.flatnonzero(length == n)
                run = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[run] + rank[at] - first[run], place[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], schema=pa.schema([*(batch.schema.field(c) for c in names), ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    return ranked.mapInArrow(placed, schema)
