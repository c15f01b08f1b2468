"""Operator 7: token ids in binary segments with Elias-Fano document boundaries.

A segment holds consecutive documents: their ids as one array (two bytes an id where the vocabulary allows), the end of
each document as an Elias-Fano sequence over that array, and the document ids as a second one. A monotone sequence of n
values below u takes about 2 + log2(u / n) bits a value; a select structure (the place of every 256th one bit) finds the
i-th boundary without decoding the rest and without 64-bit tables.

Segment layout, little endian: "EFT1"; u8 bytes an id; u64 documents, ids, nulls among the document ids; i64 first
document id; then two Elias-Fano sequences (document ids less the first, document ends) and the ids.
Elias-Fano layout: u64 values, u8 low bits, u64 bytes of lows, highs and samples; lows packed bit by bit, highs as a bit
vector, samples as u32.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import materialise, slices
from palimpsest.llm.tokens import encoder

_EVERY = 256
_HEAD = struct.Struct("<4sBQQQq")
_EF = struct.Struct("<QBQQQ")
#: Ids in a segment, about; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 18


def ef_encode(values: np.ndarray) -> bytes:
    """Non-decreasing, non-negative integers in Elias-Fano form."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    low = max(0, int((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.empty((n, 0), np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    highs, samples = np.packbits(high, bitorder="little").tobytes(), ones[::_EVERY].astype("<u4").tobytes()
    return _EF.pack(n, low, len(lows), len(highs), len(samples)) + lows + highs + samples


class EliasFano:
    """Reads one sequence that starts at `at` in a buffer; `end` is where it stops."""

    def __init__(self, buffer: bytes, at: int = 0):
        self.n, self.low, a, b, c = _EF.unpack_from(buffer, at)
        p = at + _EF.size
        self.lows, self.highs = np.frombuffer(buffer, np.uint8, a, p), np.frombuffer(buffer, np.uint8, b, p + a)
        self.samples, self.end = np.frombuffer(buffer, "<u4", c // 4, p + a + b), p + a + b + c

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low, last * self.low
        bits = np.unpackbits(self.lows[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low)
        return (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, bits are counted until the i-th one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // _EVERY])
        left, byte = i % _EVERY, at // 8
        ones = np.flatnonzero(np.unpackbits(self.highs[byte : byte + 64], bitorder="little"))
        ones = ones[ones >= at % 8]
        while len(ones) <= left:
            left -= len(ones)
            byte += 64
            ones = np.flatnonzero(np.unpackbits(self.highs[byte : byte + 64], bitorder="little"))
        return (byte * 8 + int(ones[left]) - i) << self.low | int(self._low(i, i + 1)[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        return (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low) | self._low(0, self.n)


def write_segment(doc_ids: list[int | None], arrays: list[np.ndarray], dtype) -> bytes:
    """doc_ids ascend, nulls first; one array of ids for each."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    ids = np.concatenate(arrays).astype(np.dtype(dtype).newbyteorder("<"))
    ends = np.cumsum([len(a) for a in arrays])
    gaps = known.astype(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
    return _HEAD.pack(b"EFT1", ids.itemsize, len(doc_ids), len(ids), nulls, first) + ef_encode(gaps) + ef_encode(ends) + ids.tobytes()


class Segment:
    """A written segment: document ids, boundaries by select, and ids without copying."""

    def __init__(self, buffer: bytes):
        magic, width, self.n_docs, self.n_ids, self.nulls, self.first = _HEAD.unpack_from(buffer)
        if magic != b"EFT1":
            raise ValueError("not a token segment")
        self.keys = EliasFano(buffer, _HEAD.size)
        self.ends = EliasFano(buffer, self.keys.end)
        self.ids = np.frombuffer(buffer, f"<u{width}", self.n_ids, self.ends.end)

    def doc_ids(self) -> list[int | None]:
        known = (self.keys.all() + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)
        return [None] * self.nulls + known.tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def places(self, doc_id: int) -> range:
        """Places of the documents with an id, by binary search over the sequence of ids, of which a few values are selected."""
        n = self.n_docs - self.nulls

        def bound(after: bool) -> int:
            low, high = 0, n
            while low < high:
                mid = (low + high) // 2
                value = self.keys.select(mid) + self.first
                low, high = (mid + 1, high) if value < doc_id or (after and value == doc_id) else (low, mid)
            return self.nulls + low

        return range(bound(False), bound(True))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's ids and `end_id` in ascending id order, as segments in Parquet files of the shared folder.

    Returns the written table (pid, seq, local_start, n_docs, n_ids, segment), read back: pid ascends with the document
    ids, seq within pid, local_start counts the ids of pid before the segment. Texts are range-partitioned by id, equal ids
    by a hash of the text, once and encoded where they are written. Null texts are empty (the end id only); null ids come
    first; repeated rows and rows with the same id stay, in any order among themselves; other columns, whatever their names,
    are not read; an empty table gives an empty one.
    """

    def encoded(batches):
        from pyspark import TaskContext

        pid, enc, seq, start = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def row():
            return pa.RecordBatch.from_pylist([{"pid": pid, "seq": seq, "local_start": start, "n_docs": len(keys), "n_ids": size, "segment": write_segment(keys, held, enc.dtype)}], schema=arrow)

        end = np.array([end_id], enc.dtype)
        for s in slices(batches, text_col):
            for key, ids in zip(s.column(id_col).to_pylist(), enc.encode(s.column(text_col)), strict=True):
                keys.append(key)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= SEGMENT_IDS:
                    yield row()
                    seq, start, keys, held, size = seq + 1, start + size, [], [], 0
        if keys:
            yield row()

    arrow = pa.schema([("pid", pa.int32()), ("seq", pa.int32()), ("local_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())])
    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(id_col, F.xxhash64(text_col)).sortWithinPartitions(id_col)
    return materialise(ordered.mapInArrow(encoded, "pid int, seq int, local_start long, n_docs long, n_ids long, segment binary"), "tokens")


def read_documents(written: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of each document of a written table; ids as unsigned 32-bit little-endian bytes.

    The driver holds one number per written partition, the ids before it, as it holds every task's state anyway.
    """
    spark = written.sparkSession
    before, total = {}, 0
    for pid, n in written.groupBy("pid").agg(F.sum("n_ids")).orderBy("pid").collect():
        before[pid], total = total, total + n
    known = spark.sparkContext.broadcast(before)

    def decoded(batches):
        for batch in batches:
            for r in batch.to_pylist():
                s = Segment(r["segment"])
                ends = s.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = s.ids.astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(), pa.int64()), pa.array(starts + known.value[r["pid"]] + r["local_start"]), pa.array(ends - starts), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], [id_col, "start", "n_tokens", "ids"])

    return written.mapInArrow(decoded, f"{id_col} long, start long, n_tokens long, ids binary")


def lookup(written: DataFrame, wanted: list[int], id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids) of the documents with the ids wanted, a list of a caller's; segments are searched by select, and only
    the boundaries and ids of these documents are decoded. Ids that are not there give no row, repeated ones a row each."""
    sent = written.sparkSession.sparkContext.broadcast(sorted(set(wanted)))

    def found(batches):
        for batch in batches:
            for blob in batch.column("segment").to_pylist():
                s = Segment(blob)
                hits = [(i, s.document(k).astype("<u4")) for i in sent.value for k in s.places(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hits], pa.int64()), pa.array([len(x) for _, x in hits], pa.int64()), pa.array([x.tobytes() for _, x in hits], pa.binary())], [id_col, "n_tokens", "ids"])

    return written.select("segment").mapInArrow(found, f"{id_col} long, n_tokens long, ids binary")
