"""Operator 10: removal of repeated word sequences by prefix-partitioned suffix trees.

The suffix tree meant here holds every suffix that starts a full window of `window` words, cut at that depth. An internal node
at that depth, one with two leaves or more, is a repeat, and all its leaves but the first are covered; neighbouring covered
windows join to the spans of words that go. The tree is never built whole:

1. A filter. The synchronising phrase of a window is the 8-word run with the least hash inside it. Equal windows have equal
   phrases, and neighbouring windows mostly share one, so about a seventh as many phrases as suffixes are exchanged. Suffixes
   whose phrase occurs once can have no deep internal node above them and are left out of the tree.
2. Suffixes are split by prefixes of their text of variable length: the first word, or the first 2, 4 or 8, or the whole window.
   A first pass counts suffixes by the hash cell of each of these prefixes. A suffix belongs to the
   shortest of its prefixes whose cell holds no more suffixes than fit in memory; cells that hold few share a group. Only this
   table, a bounded number of counts for each length, reaches the driver.
3. Each group builds its subtree: labels of suffixes, sorted, with the leaves below each node; a run of equal labels is a deep
   internal node, the first of its leaves stays.

Documents are dealt once to buckets of a bounded size by a hash; each step works on that same exchange. A bucket sends each
label once, however often it has it, and gets one bit back for it. So a passage that a third of all documents share is one
entry per bucket, no task holds a group of documents that grows with the input, and no text or label reaches the driver.
What stands below a prefix is named by its hash and not spelled out: labels have 96 bits (64 sorted, 32 more compared).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm._shared import as_bytes, slices
from palimpsest.llm._words import extremes, hashed, mixed, runs

#: Words of the synchronising phrase.
PHRASE = 8
#: Words of the prefixes that may name a group; the window itself is the last.
PREFIXES = (1, 2, 4, 8)
#: Cells that count prefixes of one length: at least, at most, and how many of them travel as one row.
LEAST_CELLS, MOST_CELLS, CELL_BLOCK = 1 << 16, 1 << 20, 1 << 12
#: Text of a bucket, of phrases that meet in a task, and suffixes of a group, about; from a terabyte on with the root of the size.
BUCKET_BYTES = 8 << 20
GROUP_BYTES = 6 << 20
GROUP_SUFFIXES = 3 << 19
TERABYTE = 1 << 40
LEAST = 64
_ODD = np.uint64(0xD6E8FEB86659FD93)  # any odd number


def plan_groups(counts: list[np.ndarray], most: int) -> list[np.ndarray]:
    """For each prefix length, the group of each cell; -1 where it holds more than `most` suffixes and a longer prefix decides.

    Cells of one length are joined in order to groups of at most twice `most`. All cells of the last length have a group.
    """
    out, first = [], 0
    for level, c in enumerate(counts):
        light = c <= most if level + 1 < len(counts) else np.ones(len(c), bool)
        upto = np.cumsum(np.where(light, c, 0).astype(np.int64))
        group = first + upto // most
        out.append(np.where(light, group, -1).astype(np.int32))
        first = int(group[-1]) + 1
    return out


def deep_nodes(labels: np.ndarray, more: np.ndarray, known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a group's subtree at window depth: the order of its leaves, and where in it each node begins.

    Leaves are ordered by label, then by document, null ids first; equal ones keep their order.
    """
    order = np.lexsort((keys, known, more, labels))
    a, c = labels[order], more[order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))[: len(order)]


def prefix_cells(words: np.ndarray, window: int, bits: int, label: np.ndarray | None = None):
    """The cell, by the leading bits of its hash, of each prefix of each window, from the shortest prefix on."""
    sizes = [n for n in PREFIXES if n < window]
    hashes = runs(words, *sizes, *([] if label is not None else [window]))
    for h in (*hashes, *([] if label is None else [label])):
        yield (h[: len(words) - window + 1] >> np.uint64(64 - bits)).astype(np.int64)


def prefix_counts(docs: DataFrame, window: int, bits: int, text_col: str) -> list[np.ndarray]:
    """How many windows of all texts fall in each cell, for each prefix length. Tasks count where the texts lie, without a
    shuffle, and send blocks of counts; their sums, a bounded number of blocks, are all that the driver reads."""
    levels = len([n for n in PREFIXES if n < window]) + 1

    def counted(batches):
        acc = np.zeros((levels, 1 << bits), np.int64)
        for batch in batches:
            for s in slices([batch], text_col):
                words, lengths = hashed(as_bytes(s.column(text_col)))
                count = len(words) - window + 1
                if count > 0:
                    fits = np.arange(count) + window <= np.repeat(np.cumsum(lengths), lengths)[:count]
                    for level, cells in enumerate(prefix_cells(words, window, bits)):
                        acc[level] += np.bincount(cells[fits], minlength=1 << bits)
        blocks = acc.reshape(-1, CELL_BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([zlib.compress(blocks[k].astype("<i8").tobytes(), 1) for k in used], pa.binary())], ["block", "data"])

    def summed(table: pa.Table) -> pa.Table:
        acc = np.zeros(CELL_BLOCK, np.int64)
        for blob in table.column("data").to_pylist():
            acc += np.frombuffer(zlib.decompress(blob), "<i8")
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([acc.tobytes()], pa.binary())})

    out = np.zeros((levels << bits) // CELL_BLOCK * CELL_BLOCK, np.int64).reshape(-1, CELL_BLOCK)
    kind = "block long, data binary"
    for row in docs.select(text_col).mapInArrow(counted, kind).groupBy("block").applyInArrow(summed, kind).toLocalIterator():
        out[row["block"]] = np.frombuffer(row["data"], np.int64)
    return list(out.reshape(levels, 1 << bits))


class _Cut:
    """Sorted values in runs of one group."""

    def __init__(self, groups: np.ndarray):
        begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))[: len(groups)]
        self.ids, self.begins, self.ends, self.n = groups[begins], begins, np.append(begins[1:], len(groups))[: len(begins)], len(groups)

    def rows(self, bucket: int, blob) -> pa.Table:
        data = [blob(slice(a, b)) for a, b in zip(self.begins.tolist(), self.ends.tolist(), strict=True)]
        return _sent(self.ids, np.full(len(self.ids), bucket), data)

    def bits(self, replies: pa.Table, kind: int) -> np.ndarray:
        """The bits that came back, in the order of the values."""
        out = np.zeros(self.n, bool)
        mine = replies.filter(pc.equal(replies.column("kind"), kind))
        at = np.searchsorted(self.ids, mine.column("_group").to_numpy())
        for k, data in zip(at.tolist(), mine.column("data").to_pylist(), strict=True):
            a, b = self.begins[k], self.ends[k]
            out[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
        return out


def _sent(groups, buckets, data) -> pa.Table:
    return pa.table({"_group": pa.array(groups, pa.int64()), "_bucket": pa.array(buckets, pa.int32()), "data": pa.array(data, pa.binary())})


class _Bucket:
    """Words, phrases and windows of a bucket's documents, which are ordered by id, then text."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        ids = pc.cast(table.column(id_col), pa.int64())
        known, keys = np.asarray(pc.is_valid(ids)), np.asarray(pc.fill_null(ids, 0), dtype=np.int64)
        texts = as_bytes(table.column(text_col))
        self.number = table.column("_bucket")[0].as_py()
        self.order = sorted(range(len(texts)), key=lambda i: (known[i], keys[i], texts[i]))
        self.known, self.keys, self.texts = known[self.order], keys[self.order], [texts[i] for i in self.order]
        self.words, self.lengths = hashed(self.texts)
        self.window = window
        count = len(self.words) - window + 1
        self.phrases, self.twice = np.empty(0, np.uint64), np.empty(0, bool)
        self.valid, self.label, self.phrase = np.zeros(0, bool), np.empty(0, np.uint64), np.empty(0, np.uint64)
        if count <= 0:
            return
        size = min(PHRASE, window)
        ends = np.repeat(np.cumsum(self.lengths), self.lengths)
        self.valid = np.arange(count) + window <= ends[:count]
        grams, self.label = runs(self.words, size, window)
        span = window - size + 1
        self.phrase = extremes(grams, span)
        padded = np.zeros(count + 2 * (span - 1), np.uint64)
        padded[span - 1 : span - 1 + count] = np.where(self.valid, self.phrase, np.uint64(0))
        chosen = grams[grams == extremes(padded, span, np.maximum)]
        self.phrases, times = np.unique(mixed(chosen ^ _ODD), return_counts=True)
        self.twice = times > 1

    def levels(self, bits: int):
        """The cell of each window's prefix, from the shortest prefix on; the last one is the window itself."""
        yield from prefix_cells(self.words, self.window, bits, self.label)

    def candidates(self, bits: np.ndarray) -> np.ndarray:
        """Starts of windows whose phrase is repeated in the bucket or elsewhere."""
        if not len(self.phrases):
            return np.empty(0, np.int64)
        repeated = self.twice | bits
        changes = np.flatnonzero(np.append(True, self.phrase[1:] != self.phrase[:-1]))
        named = mixed(self.phrase[changes] ^ _ODD)
        at = np.searchsorted(self.phrases, named)
        at[at == len(self.phrases)] = 0
        known = repeated[at] & (self.phrases[at] == named)
        return np.flatnonzero(np.repeat(known, np.diff(np.append(changes, len(self.phrase)))) & self.valid)

    def suffixes(self, starts: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, _Cut]:
        """(labels, first starts, cut) of the distinct labels, by group, then label."""
        labels, first = np.unique(self.label[starts], return_index=True)
        at = starts[first]
        group = np.full(len(at), -1, np.int64)
        for cells, table in zip(self.levels(int(len(groups[0])).bit_length() - 1), groups, strict=True):
            group = np.where(group < 0, table[cells[at]], group)
        order = np.argsort(group, kind="stable")
        return labels[order], at[order], _Cut(group[order])

    def check(self, starts: np.ndarray) -> np.ndarray:
        """32 more bits of each window's label."""
        acc = np.zeros(len(starts), np.uint64)
        for k in range(self.window):
            acc = acc * _ODD + self.words[starts + k]
        return (acc >> np.uint64(32)).astype(np.uint32)


def _reply(group: int, buckets: list[int], flags: np.ndarray, sizes: list[int], kind: int) -> pa.Table:
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    return pa.table({"_bucket": pa.array(buckets, pa.int32()), "_group": pa.array([group] * len(buckets), pa.int64()), "kind": pa.array([kind] * len(buckets), pa.int32()), "data": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})


_SENT, _BACK = "_group long, _bucket int, data binary", "_bucket int, _group long, kind int, data binary"
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds (n_words, n_removed, kept, spans) to every row of docs; kept is the text without covered words, joined by one blank,
    and spans are the runs of words that went, by their first word (from 0) and length.

    Words are runs without the six ASCII blanks. A window of `window` words is covered if the same words start earlier: in a
    row with a smaller id, or before in the same text. Each word of a covered window goes; windows are judged on the input.
    Null texts have no words. Null ids come before all others; rows with equal ids are ordered among themselves in some fixed
    way, so that of repeated rows one stays. Texts shorter than the window keep all words. Columns named n_words, n_removed,
    kept or spans are replaced, others stay; an empty table gives an empty result. Ids must be whole numbers.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept", "spans", "_bucket")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    grown = max(1.0, (size / TERABYTE) ** 0.5)
    buckets = max(LEAST, -(-size // int(BUCKET_BYTES * grown)))
    name_bits = max(LEAST, -(-size // int(GROUP_BYTES * grown))).bit_length()
    cells = min(max(16 * size // GROUP_BYTES, LEAST_CELLS), MOST_CELLS)
    bits = int(cells).bit_length() - 1
    dealt = docs.withColumn("_bucket", F.pmod(F.xxhash64(id_col, text_col), F.lit(buckets)).cast("int"))
    names = docs.columns
    kinds = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", _SPANS)])

    def phrase_cut(b: _Bucket) -> _Cut:
        return _Cut((b.phrases >> np.uint64(64 - name_bits)).astype(np.int64))

    def send_phrases(table: pa.Table) -> pa.Table:
        b = _Bucket(table, id_col, text_col, window)
        return phrase_cut(b).rows(b.number, lambda s: b.phrases[s].tobytes())

    def split(table: pa.Table, unpack):
        order = np.argsort(table.column("_bucket").to_numpy(), kind="stable")
        blobs, origin = table.column("data").to_pylist(), table.column("_bucket").to_pylist()
        return table.column("_group")[0].as_py(), [origin[i] for i in order], [unpack(blobs[i]) for i in order]

    def repeated_phrases(table: pa.Table) -> pa.Table:
        group, origin, sent = split(table, lambda x: np.frombuffer(x, np.uint64))
        _, back, times = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        return _reply(group, origin, times[back] > 1, [len(x) for x in sent], 0)

    counts = prefix_counts(docs, window, bits, text_col)
    groups = spark.sparkContext.broadcast(plan_groups(counts, int(GROUP_SUFFIXES * grown)))

    def send_suffixes(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _sent([], [], [])
        b = _Bucket(table, id_col, text_col, window)
        labels, at, cut = b.suffixes(b.candidates(phrase_cut(b).bits(replies, 0)), groups.value)
        owner = np.searchsorted(np.cumsum(b.lengths), at, side="right").astype(np.uint32)
        more = b.check(at)

        def blob(s: slice) -> bytes:
            docs, which = np.unique(owner[s], return_inverse=True)
            head = np.array([len(docs), s.stop - s.start], np.uint32).tobytes() + b.keys[docs].tobytes() + b.known[docs].astype(np.uint8).tobytes()
            return head + labels[s].tobytes() + more[s].tobytes() + which.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32).tobytes()

        return cut.rows(b.number, blob)

    def first_leaves(table: pa.Table) -> pa.Table:
        def unpack(x: bytes):
            k, n = (int(v) for v in np.frombuffer(x, np.uint32, 2))
            keys, known = np.frombuffer(x, np.int64, k, 8), np.frombuffer(x, np.uint8, k, 8 + 8 * k)
            p = 8 + 9 * k
            which = np.frombuffer(x, np.uint16 if k < 1 << 16 else np.uint32, n, p + 12 * n)
            return np.frombuffer(x, np.uint64, n, p), np.frombuffer(x, np.uint32, n, p + 8 * n), known[which], keys[which]

        group, origin, sent = split(table, unpack)
        order, begins = deep_nodes(*(np.concatenate([x[i] for x in sent]) for i in range(4)))
        first = np.zeros(len(order), bool)
        first[order[begins]] = True
        return _reply(group, origin, first, [len(x[0]) for x in sent], 1)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([*(table.schema.field(n) for n in names), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
        if not table.num_rows:
            return schema.empty_table()
        b = _Bucket(table, id_col, text_col, window)
        steps = np.zeros(len(b.words) + 1, np.int64)
        if replies.num_rows and len(b.phrases):
            starts = b.candidates(phrase_cut(b).bits(replies, 0))
            _, at, cut = b.suffixes(starts, groups.value)
            stays = np.isin(starts, at[cut.bits(replies, 1)])
            covered = starts[~stays]
            steps[covered] = 1
            steps[covered + window] -= 1
        gone = np.cumsum(steps[:-1]) > 0
        kept, removed, spans = [], [], []
        for text, end, n in zip(b.texts, np.cumsum(b.lengths).tolist(), b.lengths.tolist(), strict=True):
            mask = gone[end - n : end]
            words = text.split()
            removed.append(int(mask.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]))).reshape(-1, 2).tolist() if removed[-1] else []
            spans.append([{"start": x, "length": y - x} for x, y in edges])
            kept.append(b" ".join(words if not removed[-1] else [words[i] for i in np.flatnonzero(~mask)]))
        rows = table.select(names).take(pa.array(b.order))
        return pa.table([*rows.columns, pa.array(b.lengths), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, schema.field("spans").type)], schema=schema)

    once = dealt.groupBy("_bucket").applyInArrow(send_phrases, _SENT).groupBy("_group").applyInArrow(repeated_phrases, _BACK)
    deep = dealt.groupBy("_bucket").cogroup(once.groupBy("_bucket")).applyInArrow(send_suffixes, _SENT).groupBy("_group").applyInArrow(first_leaves, _BACK)
    return dealt.groupBy("_bucket").cogroup(once.unionByName(deep).groupBy("_bucket")).applyInArrow(finish, kinds)
