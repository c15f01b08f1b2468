"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are lexicon densities (a short fixed list and a list learned from labelled rows, whole words and word
beginnings), closeness of lexicon words to second-person words, capitals, punctuation and obfuscation rates. Every one is a
sum over words, so each distinct word is described once per worker. Labelled rows are split by a hash in three: terms are
learned on the first part, trees on the second, and the isotonic curve on the third.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._linear import logistic
from palimpsest.llm._shared import as_bytes, slices
from palimpsest.llm._words import WordIndex

#: Labelled rows that a model is fitted on, about, and terms that the learned list may have.
SAMPLE_ROWS, MAX_TERMS = 15_000, 3000
NEAR = 5
# Fixed word lists: common insults, and second-person words, of four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers clown trash scum pathetic worthless disgusting imbecile jerk bastard bitch asshole fool fucking fuck shit crap retard filthy vermin "
    "dumm dummkopf trottel arschloch abschaum versager wertlos widerlich scheiße "
    "connard imbécile stupide ordure minable dégoûtant crétin merde "
    "estúpido imbécil basura asqueroso patético inútil mierda".split()
)
SECOND = frozenset("you your yours yourself ya du dich dir dein deine euch ihr sie tu te toi vous votre vos ton ta tes ti usted ustedes vosotros os su".split())
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[^\W\d_][\d@$!*#.\-]+[^\W\d_]")
_SWAPS = str.maketrans("013457@$!*", "oieastasi\0")
_STRETCHED = re.compile(r"(.)\1\1+")
_LEAST = 4
FEATURES = ["log_words", "fixed_density", "fixed_count", "learned_density", "learned_count", "log_odds_sum", "log_odds_max", "near_second", "second_density", "capitals", "titles", "exclamations", "questions", "punctuation", "obfuscated", "word_length"]


def terms_of(word: str) -> set[str]:
    """The bare word, and its beginnings of 4 to 7 letters with a mark."""
    return {word, *(f"{word[:n]}-" for n in range(_LEAST, 8) if len(word) >= n)} if word else set()


def _bare(word: str) -> str:
    return _EDGES.sub("", word).lower()


class _Words:
    """Describes words by columns that sum to a text's features."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.heads = {t.rstrip("-")[:_LEAST] for t in terms} | {w[:_LEAST] for w in INSULTS} | {w[:_LEAST] for w in SECOND}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        out = np.zeros((len(words), 10), np.float32)
        heads, described = self.heads, self._described
        for i, raw in enumerate(words):
            word = raw.decode("utf-8", "replace")
            if not (word.isalpha() and word.islower()) or word[:_LEAST] in heads or _STRETCHED.search(word):
                out[i] = described(word)
        return out, np.fromiter(map(len, words), np.float64, len(words))

    def _described(self, word: str) -> tuple:
        bare = _bare(word)
        inside = not bare.isalpha() and bool(_INSIDE.search(word)) or bool(_STRETCHED.search(bare))
        plain = _STRETCHED.sub(r"\1", bare.translate(_SWAPS)) if inside else bare
        known = max((self.terms.get(t, 0.0) for t in terms_of(bare)), default=0.0) if bare[:_LEAST] in self.heads else 0.0
        signs = 0 if word.isalnum() else sum(not c.isalnum() for c in word)
        caps = word.isupper() and sum(map(str.isalpha, word)) > 1
        return (plain in INSULTS or bare in INSULTS, known > 0, known, bare in SECOND, caps, word[:1].isupper(), word.count("!") if signs else 0, word.count("?") if signs else 0, signs, inside)


def features(index: WordIndex, texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    numbers, (columns, size) = index(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, x in enumerate(numbers):
        n = len(x)
        if not n:
            continue
        rows = columns[x]
        fixed, learned, odds, second, caps, titles, bangs, asks, signs, hidden = rows.sum(axis=0)
        marked, near = np.flatnonzero(rows[:, 0] + rows[:, 1]), 0
        if second and len(marked):
            you = np.flatnonzero(rows[:, 3])
            at = np.searchsorted(you, marked)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - marked), np.abs(you[np.maximum(at - 1, 0)] - marked))
            near = int((gap <= NEAR).sum())
        out[i] = (math.log1p(n), fixed / n, fixed, learned / n, learned, odds, rows[:, 2].max(), near / n, second / n, caps / n, titles / n, bangs / n, asks / n, signs / n, hidden / n, size[x].sum() / n)
    return out


class Trees:
    """Boosted regression trees of logistic loss over binned features; each tree has 2 ** depth leaves at most."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 1.0):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
        self.start = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        self.rate, self.trees = rate, []
        binned = self._binned(x)
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = logistic(score)
            tree = self._grow(binned, p - y, p * (1 - p), depth, least)
            if tree is None:
                break
            self.trees.append(tree)
            score += rate * self._leaves(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def _grow(self, binned, g, h, depth, least):
        node = np.zeros(len(g), np.int64)
        splits, values = {}, {}
        for level in range(depth):
            for k in range(1 << level):
                rows = np.flatnonzero(node == k)
                best = (1e-6, None, None)
                if len(rows) >= 2:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(self.cuts):
                        gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                        gain = np.where((hl >= least) & (total_h - hl >= least), gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1), 0)
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), j, int(gain.argmax()))
                splits[level, k] = best[1:]
            if level == 0 and splits[0, 0][0] is None:
                return None
            node = self._step(splits, level, node, binned)
        for k in range(1 << depth):
            rows = node == k
            values[k] = -g[rows].sum() / (h[rows].sum() + 1)
        return splits, np.array([values[k] for k in range(1 << depth)]), depth

    @staticmethod
    def _step(splits, level, node, binned):
        right = np.zeros(len(node), bool)
        for k in range(1 << level):
            j, cut = splits[level, k]
            if j is not None:
                right |= (node == k) & (binned[:, j] > cut)
        return node * 2 + right

    def _leaves(self, tree, binned):
        splits, values, depth = tree
        node = np.zeros(len(binned), np.int64)
        for level in range(depth):
            node = self._step(splits, level, node, binned)
        return values[node]

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.start + self.rate * sum((self._leaves(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step means of y over x, each drawn a little towards the mean, by pooling neighbours."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, label in zip(x[order], y[order], strict=True):
        blocks.append([v, v, float(label), 1.0])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            _, last, total, n = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + total, blocks[-1][3] + n
    mean = float(y.mean()) if len(y) else 0.5
    at = np.array([v for b in blocks for v in (b[0], b[1])])
    return at, np.array([(b[2] + mean) / (b[3] + 1) for b in blocks for _ in range(2)])


class ToxicityModel:
    def __init__(self, terms: dict[str, float], trees: Trees, curve: tuple[np.ndarray, np.ndarray]):
        self.terms, self.trees, self.curve = terms, trees, curve

    def index(self) -> WordIndex:
        return WordIndex(_Words(self.terms))

    def scores(self, x: np.ndarray) -> np.ndarray:
        margins = self.trees.margins(x)
        return np.interp(margins, *self.curve) if len(self.curve[0]) else logistic(margins)


def _learned(counts: list[tuple[str, int, int]], toxic: int, clean: int, most: int) -> dict[str, float]:
    """Terms with much more than their share of toxic texts, by a likelihood ratio, with their log odds."""
    out = []
    prior = toxic / max(1, toxic + clean)
    for term, a, b in counts:
        p = a / (a + b)
        if a < 4 or p <= prior or toxic == 0 or clean == 0:
            continue
        gain = 2 * (a * math.log(p / prior) + (b * math.log((1 - p) / (1 - prior)) if b else 0))
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if gain >= 16 and odds >= 1.5:
            out.append((gain, term, odds))
    return {t: o for _, t, o in sorted(out, reverse=True)[:most]}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on about `sample` labelled rows, chosen by a hash of their id. Null labels are left out; null texts are empty.

    Terms are counted as a Spark aggregate and only those that pass the test reach the driver, the best `max_terms` of them
    are used; of other rows only the dense features do. Without both labels every text scores near the known label's share.
    """
    known = labels.select(id_col, F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1))
    share = min(1.0, sample / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.lit(8), id_col), F.lit(1 << 30))
    chosen = known.filter(place < share * (1 << 30)).withColumn("_part", F.pmod(F.xxhash64(F.lit(88), id_col), F.lit(5)).cast("int"))
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)

    def counted(batches):
        for batch in batches:
            found: tuple[Counter, Counter] = Counter(), Counter()
            for text, label in zip(as_bytes(batch.column(text_col)), batch.column("_y").to_pylist(), strict=True):
                words = {_bare(w.decode("utf-8", "replace")) for w in set(text.split())}
                found[label].update(set().union(*map(terms_of, words)))
            terms = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    sizes = dict(chosen.filter("_part < 2").groupBy("_y").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = toxic / max(1, toxic + clean)
    counts = rows.filter("_part < 2").mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = counts.filter((F.col("toxic") >= 4) & (F.col("toxic") > 3 * prior * (F.col("toxic") + F.col("clean"))) if prior < 0.3 else F.col("toxic") >= 4)
    ratio = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    terms = _learned([tuple(r) for r in likely.orderBy(ratio.desc(), "term").limit(4 * max_terms).collect()], toxic, clean, max_terms)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def measured(batches):
        index = WordIndex(_Words(sent.value))
        for s in slices(batches, text_col):
            x = features(index, as_bytes(s.column(text_col)))
            yield pa.RecordBatch.from_arrays([s.column("_y"), s.column("_part"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "part", "x"])

    got = sorted(rows.filter("_part >= 2").mapInArrow(measured, "y int, part int, x binary").collect(), key=lambda r: (r[1], r[2], r[0]))
    x = np.array([np.frombuffer(r[2]) for r in got]).reshape(-1, len(FEATURES))
    y, last = np.array([r[0] for r in got], float), np.array([r[1] for r in got]) == 4
    trees = Trees(x[~last], y[~last])
    return ToxicityModel(terms, trees, isotonic(trees.margins(x[last]), y[last]))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; predicted is 1 from `threshold` on.

    A null text is empty and is scored like any other. Only the text is read; repeated rows and null ids stay; an empty table
    gives an empty result. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: list[WordIndex] = []

    def told(batches):
        if not state:
            state.append(sent.value.index())
        for s in slices(batches, text_col):
            got = sent.value.scores(features(state[0], as_bytes(s.column(text_col))))
            yield pa.RecordBatch.from_arrays([s.column(id_col), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(told, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
