"""Operator 12: product codes of vectors by Lloyd's rounds with filtering kd-trees.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of its own. Every task cuts
its vectors into blocks and builds a balanced kd-tree over each part position of a block, with bounding boxes and cached sums and
counts; trees are written once and read in each round. A round sends all codebooks down the trees level by level: of the entries
still possible for a node the one nearest to its box's middle is kept, and another goes if no point of the box can prefer it. A
node with one entry left gives its sum and count to it as a whole and is not opened; at the leaves the points themselves
are compared. Ties go to the lower entry, and all is in integers, so codes are those of a plain search. Each task adds up its
blocks; a few numbers for each entry of the codebooks, whose number is a parameter, reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import join_back, materialise

#: Components of all vectors of a block, about.
BLOCK_VALUES = 1 << 20
#: Points of a leaf, at most.
LEAF = 16
#: Nodes, or points of leaves, that are compared with all entries at once.
AT_ONCE = 1 << 12
#: Larger components leave 64 bits when squared and summed, and are reckoned in Python's integers.
_WIDE = 1 << 24


@dataclass
class Tree:
    """points in the order of leaves; order: their places in the block; for each level, from the root: where nodes start, low and high corners, sums."""

    points: np.ndarray
    order: np.ndarray
    starts: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A balanced tree: every level halves all nodes across their widest side, until no leaf has more than `leaf` points."""
    order, bounds = np.arange(len(points)), np.array([0, len(points)])
    tree = Tree(points, order, [], [], [], [])
    while True:
        starts, held = bounds[:-1], points[order]
        tree.starts.append(starts)
        tree.low.append(np.minimum.reduceat(held, starts, axis=0))
        tree.high.append(np.maximum.reduceat(held, starts, axis=0))
        tree.sums.append(np.add.reduceat(held, starts, axis=0))
        sizes = np.diff(bounds)
        if sizes.max() <= leaf:
            tree.points, tree.order = held, order
            return tree
        node = np.repeat(np.arange(len(starts)), sizes)
        widest = np.argmax(tree.high[-1] - tree.low[-1], axis=1)
        order = order[np.lexsort((held[np.arange(len(held)), widest[node]], node))]
        bounds = np.append(np.stack([starts, starts + sizes // 2], 1).ravel(), len(points))


def _nearest(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The nearest allowed entry of each point, the lower one of equally near ones."""
    distance = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return np.argmin(np.where(allowed, distance, distance.max() + 1), axis=1)


def _left(low: np.ndarray, high: np.ndarray, entries: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The entries that some point of a box may prefer to all others.

    An entry is worse than the middle's nearest one everywhere if it is so at the corner that lies furthest towards it."""
    best = _nearest(low + high, 2 * entries, allowed)
    towards = entries[None] - entries[best][:, None, :]
    corner = np.where(towards > 0, high[:, None, :], low[:, None, :])
    more = ((corner - entries[None]) ** 2).sum(axis=2) - ((corner - entries[best][:, None, :]) ** 2).sum(axis=2)
    index = np.arange(len(entries))
    out = allowed & ~((more > 0) | ((more == 0) & (index[None] > best[:, None])))
    out[np.arange(len(best)), best] = True
    return out


def assign(tree: Tree, entries: np.ndarray, codes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """Counts and sums of each entry's points, the code of each point in the block's order if asked for, and how many points were compared one by one."""
    if object in (tree.points.dtype, tree.sums[0].dtype):
        entries = entries.astype(object)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros_like(entries)
    told = np.zeros(len(tree.points), np.int64) if codes else None
    nodes, allowed, opened = np.array([0]), np.ones((1, len(entries)), bool), 0
    for depth, starts in enumerate(tree.starts):
        ends = np.append(starts[1:], len(tree.points))
        parts = [slice(i, i + AT_ONCE) for i in range(0, len(nodes), AT_ONCE)]
        allowed = np.concatenate([_left(tree.low[depth][nodes[p]], tree.high[depth][nodes[p]], entries, allowed[p]) for p in parts])
        single = allowed.sum(axis=1) == 1
        whole, entry = nodes[single], np.argmax(allowed[single], axis=1)
        np.add.at(counts, entry, (ends - starts)[whole])
        np.add.at(sums, entry, tree.sums[depth][whole])
        if codes:
            sizes = (ends - starts)[whole]
            told[_spans(starts[whole], sizes)] = np.repeat(entry, sizes)
        nodes, allowed = nodes[~single], allowed[~single]
        if not len(nodes):
            break
        if depth + 1 < len(tree.starts):
            nodes, allowed = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(allowed, 2, axis=0)
    sizes = (ends - starts)[nodes] if len(nodes) else np.empty(0, np.int64)
    at, owner = _spans(starts[nodes], sizes) if len(nodes) else sizes, np.repeat(np.arange(len(nodes)), sizes)
    for i in range(0, len(at), AT_ONCE):
        some = at[i : i + AT_ONCE]
        code = _nearest(tree.points[some], entries, allowed[owner[i : i + AT_ONCE]])
        opened += len(some)
        np.add.at(counts, code, 1)
        np.add.at(sums, code, tree.points[some])
        if codes:
            told[some] = code
    if codes:
        out = np.empty_like(told)
        out[tree.order] = told
        told = out
    return counts, sums, told, opened


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one span after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _to_bytes(x: np.ndarray) -> bytes:
    """Integers as little-endian 32-bit or 64-bit ones, or as text if they are wider."""
    if x.dtype == object:
        return b"t" + ",".join(map(str, x.ravel())).encode()
    narrow = x.size == 0 or (x.min() >= -(1 << 31) and x.max() < 1 << 31)
    return (b"i" + x.astype("<i4").tobytes()) if narrow else (b"l" + x.astype("<i8").tobytes())


def _from_bytes(b: bytes, width: int) -> np.ndarray:
    if b[:1] == b"t":
        flat = np.array([int(x) for x in b[1:].decode().split(",")], object)
    else:
        flat = np.frombuffer(b, "<i4" if b[:1] == b"i" else "<i8", offset=1).astype(np.int64)
    return flat.reshape(-1, width) if width > 1 else flat


def _dump(tree: Tree) -> list[bytes]:
    return [_to_bytes(tree.points), _to_bytes(tree.order), *(_to_bytes(np.concatenate(x)) for x in (tree.starts, tree.low, tree.high, tree.sums))]


def _load(fields: list[bytes], width: int) -> Tree:
    points, order, starts, *boxes = (_from_bytes(f, w) for f, w in zip(fields, (width, 1, 1, width, width, width), strict=True))
    order, starts = order.ravel(), starts.ravel()
    cut = np.cumsum(2 ** np.arange(int(np.log2(len(starts) + 1))))[:-1]  # level k has 2**k nodes
    return Tree(points.reshape(-1, width), order, np.split(starts, cut), *(np.split(b.reshape(-1, width), cut) for b in boxes))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in 64 bits where squares fit and in Python's integers elsewhere. scale is a power of two, so the product is exact."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if values.size == 0 or np.abs(scaled).max() < _WIDE:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, dim)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, vector, label) without null vectors and those with null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("id"), v.alias("vector"), label.alias("label")).filter(F.col("vector").isNotNull() & ~F.exists("vector", bad))


def first_codebooks(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """(parts, entries, width): the parts of the kept vectors of least id; null ids come last, equal ids by their vectors. None if there are none."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()  # `entries` rows
    if not rows:
        return None
    dim = len(rows[0].vector)
    if dim == 0 or dim % parts or any(len(r.vector) != dim for r in rows):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return np.ascontiguousarray(integers(np.array([r.vector for r in rows], float), scale).reshape(len(rows), parts, dim // parts).transpose(1, 0, 2))


def trees(kept: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """Blocks of vectors: ids, labels, and for each part position the six fields of its tree."""
    block_rows = max(1, BLOCK_VALUES // (parts * width))
    kinds = kept.schema
    schema = f"ids array<{kinds['id'].dataType.simpleString()}>, labels array<{kinds['label'].dataType.simpleString()}>, trees array<array<binary>>"

    def blocks(batches):
        held, n = [], 0
        for b in batches:
            while n + b.num_rows >= block_rows:
                held.append(b.slice(0, block_rows - n))
                b = b.slice(block_rows - n)
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            if b.num_rows:
                held.append(b)
                n += b.num_rows
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def built(batches):
        for t in blocks(batches):
            column = t.column("vector").combine_chunks()
            if pc.min(pc.list_value_length(column)).as_py() != parts * width or pc.max(pc.list_value_length(column)).as_py() != parts * width:
                raise ValueError(f"vectors must have {parts * width} components as the first ones have")
            points = integers(_matrix(column, parts * width), scale)
            made = [_dump(build(points[:, k * width : (k + 1) * width])) for k in range(parts)]
            one = lambda name: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(name).combine_chunks())
            yield pa.RecordBatch.from_arrays([one("id"), one("label"), pa.array([made], pa.list_(pa.list_(pa.binary())))], ["ids", "labels", "trees"])

    return kept.mapInArrow(built, schema)


def _blocks(batches, width: int):
    """(row of a batch, trees of its part positions)."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1), [_load(fields, width) for fields in b.column("trees")[i].as_py()]


#: Sums of any width leave a task as numbers of so many bits, the highest with the sign, so that they can be added as longs.
_BITS = 40


def _pieces(x: int) -> list[int]:
    out = []
    while not -(1 << _BITS) <= x < 1 << _BITS:
        out.append(x & ((1 << _BITS) - 1))
        x >>= _BITS
    return [*out, x]


def _round(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: floors of means; entries without points stay."""
    parts, entries, width = books.shape

    def added(batches):
        sums = np.zeros((parts, entries, width + 1), object)  # the last is the count
        for _, block in _blocks(batches, width):
            for k, tree in enumerate(block):
                n, s, _, _ = assign(tree, books[k])
                sums[k, :, :width] += s.astype(object)
                sums[k, :, width] += n
        rows = [(k, e, c, at, piece) for k, e, c in zip(*np.nonzero(sums), strict=True) for at, piece in enumerate(_pieces(int(sums[k, e, c])))]
        kinds = [pa.int32()] * 4 + [pa.int64()]
        names = ["part", "entry", "component", "piece", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    told = forest.select("trees").mapInArrow(added, "part int, entry int, component int, piece int, value long")
    sums = np.zeros((parts, entries, width + 1), object)
    for r in told.groupBy("part", "entry", "component", "piece").agg(F.sum("value").alias("value")).collect():  # as many as the codebooks have numbers
        sums[r.part, r.entry, r.component] += r.value << _BITS * r.piece
    out, used = books.astype(object), sums[:, :, width] > 0
    out[used] = sums[used][:, :width] // sums[used][:, width:]
    return _narrow(out)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if max(abs(int(x.min())), abs(int(x.max()))) < _WIDE else x


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def _coded(forest: DataFrame, books: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    parts, _, width = books.shape
    two = np.array([f"{i:02x}" for i in range(256)], "S2")

    def coded(batches):
        for row, block in _blocks(batches, width):
            codes = np.stack([assign(tree, books[k], codes=True)[2] for k, tree in enumerate(block)], 1)
            error = np.zeros(len(codes), object if any(t.points.dtype == object for t in block) or books.dtype == object else np.int64)
            for k, tree in enumerate(block):
                error[tree.order] += ((tree.points - books[k][codes[tree.order, k]]) ** 2).sum(axis=1)
            text = two[codes].view(f"S{2 * parts}").ravel().astype(str)
            told = [int(e) if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), pa.array(text, pa.string()), pa.array(told, pa.int64())], ["id", "label", "code", "error"])

    return forest.mapInArrow(coded, f"id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, np.ndarray]:
    """(coded vectors, codebooks): id, label, code (two hex digits a part, at most 256 entries) and error of each kept vector, and
    the final codebooks as an array (part, entry, component).

    Null vectors and those with null or non-finite components are dropped. Vectors must have one length, a multiple of `parts`;
    others are an error. With fewer kept vectors than entries, codebooks have an entry each; with none there are no rows and the
    codebooks are empty. Repeated ids are coded one by one. An error, or sum of errors, that leaves 64 bits is null. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    books = first_codebooks(kept, parts, entries, scale)
    kinds = [kept.schema[c].dataType.simpleString() for c in ("id", "label")]
    if books is None:
        none = kept.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumnsRenamed({"id": id_col, "label": label_col or "label"}), np.zeros((parts, 0, 0), np.int64)
    forest = materialise(trees(kept, parts, books.shape[2], scale), "trees")
    for _ in range(rounds):
        books = _round(forest, books)
    return _coded(forest, books, *kinds).withColumnsRenamed({"id": id_col, "label": label_col or "label"}), books


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds the error summed over equal labels, nulls together: summed in each task first, then joined back, hot labels by broadcast."""
    stored = materialise(coded, "coded")
    sums = materialise(stored.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"), F.try_sum("error").alias("label_error")), "label_sums")
    return join_back(stored, sums, label_col, "_n", stored.count()).drop("_n")
