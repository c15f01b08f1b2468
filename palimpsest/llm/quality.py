"""Operator 9: quality by Naive Bayes support vectors.

A text's features are indicators of hashed n-grams: its words, and runs of one to three word shapes (letter case, length class,
edge and inner signs, non-ASCII letters, and whether the word repeats one that stands up to 16 words before). Indicators are
scaled by the log ratio of their smoothed counts in the two classes; a linear hinge-loss model is fitted on them by dual
coordinate descent, and its weights are drawn towards their mean size, as Naive Bayes would have them. A logistic curve fitted
on rows left out of that turns margins into scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._linear import dual_coordinate_descent, logistic
from palimpsest.llm._shared import as_bytes, kept, slices
from palimpsest.llm._words import WordIndex, mixed

DIMS = 1 << 15
#: Labelled rows that a model is fitted on, about.
SAMPLE_ROWS = 6_000
#: Texts whose flags are held at once, a row of DIMS bytes each.
FLAG_ROWS = 256
_REPEATS = 16
_SHARE = 0.25
_SIGNS = re.compile(r"[^\w\s]+")


def _shape(word: str) -> str:
    if word.islower() and word.isalpha():
        return f"a{min(6, len(word).bit_length())}{'' if word.isascii() else 'u'}"
    letters = [c for c in word if c.isalpha()]
    case = "0" if not letters else "A" if len(letters) > 1 and all(c.isupper() for c in letters) else "Aa" if word[0].isupper() else "aA" if any(c.isupper() for c in letters) else "a"
    signs = "".join(dict.fromkeys(x[:3] for x in _SIGNS.findall(word)))[:6]
    return f"{case}{min(6, len(word).bit_length())}{'d' if any(c.isdigit() for c in word) else ''}{'u' if not word.isascii() else ''}{signs}"


def _described(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    texts = [w.decode("utf-8", "replace") for w in words]
    shapes = [_shape(w) for w in texts]
    known = {x: xxhash.xxh3_64_intdigest(x) for x in set(shapes)}
    return np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in texts), np.uint64, len(texts)), np.fromiter(map(known.__getitem__, shapes), np.uint64, len(texts))


def indicators(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """Which n-grams each text has: one row of `dims` flags for each."""
    numbers, (words, shapes) = kept("quality", lambda: WordIndex(_described))(texts)
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
    text = np.repeat(np.arange(len(numbers)), lengths)
    flags = np.zeros(len(texts) * dims, bool)

    def put(owner: np.ndarray, h: np.ndarray):
        flags[owner * dims + (mixed(h) & np.uint64(dims - 1)).astype(np.int64)] = True

    word, shape = words[flat], shapes[flat]
    put(text, word)
    far = np.zeros(len(flat), np.uint64)
    for d in range(_REPEATS, 0, -1):
        if len(flat) > d + 1:
            same = (flat[d + 1 :] == flat[1:-d]) & (flat[d:-1] == flat[: -d - 1]) & (text[d + 1 :] == text[: -d - 1])
            far[d + 1 :][same] = d
    shape = shape + far * np.uint64(0x9E3779B97F4A7C15)
    put(text, shape)
    for n, odd in ((2, 3), (3, 5)):
        if len(flat) >= n:
            acc = np.full(len(flat) - n + 1, odd, np.uint64)
            for k in range(n):
                acc = mixed(acc + shape[k : k + len(acc)])
            inside = text[: len(acc)] == text[n - 1 :]
            put(text[: len(acc)][inside], acc[inside])
    return flags.reshape(len(texts), dims)


class QualityModel:
    """Weights of indicators, a bias, and the logistic curve from margins to scores."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, dims: int = DIMS, smooth: float = 1.0, cost: float = 0.1):
        self.weights, self.bias, self.curve, self.prior = np.zeros(dims), 0.0, (1.0, 0.0), float(y.mean()) if len(y) else 0.5
        held = np.arange(len(rows)) % 5 == 4
        if not 0 < y[~held].sum() < (~held).sum():
            self.curve = (0.0, float(np.log((self.prior + 1e-3) / (1 - self.prior + 1e-3))))
            return
        counts = np.full((2, dims), smooth)
        for r, label in zip([r for r, h in zip(rows, held, strict=True) if not h], y[~held], strict=True):
            counts[int(label), r] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        fitted = [(r, ratio[r] / np.sqrt(len(r) + 1.0)) for r in rows]
        balance = (~held).sum() / (2 * np.array([(y[~held] == 0).sum(), y[~held].sum()]))
        w = dual_coordinate_descent([f for f, h in zip(fitted, held, strict=True) if not h], 2.0 * y[~held] - 1, dims, cost * 100 * balance[y[~held].astype(int)])
        w[:dims] = (1 - _SHARE) * w[:dims] + _SHARE * np.abs(w[:dims]).mean()
        self.weights, self.bias = w[:dims] * ratio, float(w[dims])
        at = np.flatnonzero(held) if 0 < y[held].sum() < held.sum() else np.arange(len(rows))
        margins = np.array([self.weights[rows[i]].sum() / np.sqrt(len(rows[i]) + 1.0) + self.bias for i in at])
        self.curve = _curve(margins, y[at])

    def scores(self, flags: np.ndarray) -> np.ndarray:
        n = flags.sum(axis=1)
        margins = np.array([self.weights[row].sum() for row in flags]) / np.sqrt(n + 1.0) + self.bias
        return logistic(self.curve[0] * margins + self.curve[1])


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(30):
        p = logistic(a * margin + b)
        g = x.T @ (p - y) + 1e-2 * np.array([a - 1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-3])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fits on about `sample` labelled rows, chosen by a hash of their id. Null labels are left out; null texts are empty.

    The ids of the sample, bounded by it, are broadcast; the rows' feature ids reach the driver. With labels of one class only
    every text scores that class's share.
    """
    known = labels.select(id_col, F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(9), id_col), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)

    def measured(batches):
        for s in (x for b in batches for x in slices(iter([b]), text_col, 1 << 20, FLAG_ROWS)):
            flags = indicators(as_bytes(s.column(text_col)))
            yield pa.RecordBatch.from_arrays([s.column(id_col).cast(pa.string()), s.column("_y"), pa.array([np.flatnonzero(f).astype(np.uint16).tobytes() for f in flags], pa.binary())], ["id", "y", "at"])

    got = sorted(rows.mapInArrow(measured, "id string, y int, at binary").collect(), key=lambda r: (xxhash.xxh3_64_intdigest(r[0] or ""), r[2]))
    return QualityModel([np.frombuffer(r[2], np.uint16).astype(np.int64) for r in got], np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; predicted is 1 from `threshold` on.

    A null text is empty and is scored like any other. Only the text is read; repeated rows and null ids stay; an empty table
    gives an empty result. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches):
        for s in (x for b in batches for x in slices(iter([b]), text_col, 1 << 20, FLAG_ROWS)):
            got = sent.value.scores(indicators(as_bytes(s.column(text_col))))
            yield pa.RecordBatch.from_arrays([s.column(id_col), pa.array(got), pa.array((got >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(told, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
