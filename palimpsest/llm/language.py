"""Operator 5: language identification by hierarchical discrimination.

A text's features are rates of hashed character 1- to 4-grams of its words. A first set of one-versus-rest linear classifiers
chooses the language family; one-versus-one linear support vector machines then separate the languages of that family by votes.
All are linear, so a text's scores are the sums of its words' scores, and each distinct word is scored once per worker.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._linear import dual_coordinate_descent, gram_ids, logistic, sums
from palimpsest.llm._shared import as_bytes, slices
from palimpsest.llm._words import WordIndex

GRAMS, DIMS = (1, 2, 3, 4), 1 << 13
#: Brings rates near unit length.
SCALE = 8.0
#: Labelled rows of a language that a model is fitted on, about.
SAMPLE_PER_LANGUAGE = 600
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi", "romance": "an ast ca es fr gl it la oc pt ro", "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv", "celtic": "br cy ga gd", "uralic": "et fi hu", "turkic": "az kk ky tk tr tt ug uz", "indic": "bn gu hi mr ne pa sa si ur", "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te", "semitic": "am ar he mt", "malayic": "id jv ms su tl", "sinitic": "yue zh", "hellenic": "el", "albanian": "sq", "armenian": "hy", "georgian": "ka", "japonic": "ja", "koreanic": "ko", "vasconic": "eu", "austroasiatic": "km vi", "tai": "lo th",
}
_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def family_of(lang: str) -> str:
    """A language that no family lists is its own."""
    return _OF.get(lang.split("-")[0].lower(), lang)


def _plain(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Lower-case letters of words, and whether there is one."""
    plain = [w.translate(None, _NO_LETTERS).decode("utf-8", "replace").lower() for w in words]
    return [w.encode() for w in plain], np.fromiter((any(map(str.isalpha, w)) for w in plain), bool, len(plain))


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled rates of a text's n-grams."""
    words, letters = _plain(text.split())
    ids, _ = gram_ids([w for w, ok in zip(words, letters, strict=True) if ok], GRAMS, DIMS)
    at, n = np.unique(ids, return_counts=True)
    return at.astype(np.int32), (SCALE * n / max(1, n.sum())).astype(np.float32)


class LanguageModel:
    """Families, languages and the weights of their classifiers."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs = sorted({r[0] for r in rows})
        self.families = sorted({family_of(x) for x in self.langs})
        self.family = np.array([self.families.index(family_of(x)) for x in self.langs])
        features = [(r[1], r[2].astype(float)) for r in rows]
        lang = np.array([self.langs.index(r[0]) for r in rows])
        tasks = [(np.arange(len(rows)), np.where(self.family[lang] == f, 1, -1)) for f in range(len(self.families))]
        self.pairs = [(a, b) for a, b in combinations(range(len(self.langs)), 2) if self.family[a] == self.family[b]]
        for a, b in self.pairs:
            chosen = np.flatnonzero((lang == a) | (lang == b))
            tasks.append((chosen, np.where(lang[chosen] == a, 1, -1)))
        self.weights = np.array([dual_coordinate_descent([features[i] for i in at], y, DIMS, 10.0) for at, y in tasks]).reshape(-1, DIMS + 1)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each row of margins."""
        k = len(self.families)
        chance = logistic(4 * margins)
        family = margins[:, :k].argmax(axis=1) if k > 1 else np.zeros(len(margins), int)
        sure = chance[np.arange(len(margins)), family] if k > 1 else np.ones(len(margins))
        votes, total, met = (np.zeros((len(margins), len(self.langs))) for _ in range(3))
        for j, (a, b) in enumerate(self.pairs):
            p = chance[:, k + j]
            votes[:, a] += p > 0.5
            votes[:, b] += p <= 0.5
            total[:, a] += p
            total[:, b] += 1 - p
            met[:, [a, b]] += 1
        outside = self.family[None, :] != family[:, None]
        best = np.where(outside, -1.0, votes + total / (met.max() + 1)).argmax(axis=1)
        at = np.arange(len(margins)), best
        return best, sure * np.where(met[at] > 0, total[at] / np.maximum(met[at], 1), 1.0)


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fits on about `per_language` rows of each language, chosen by a hash of their id; null texts and languages are left out.

    Only the chosen rows' n-gram rates reach the driver. No labelled row gives a model that knows no language.
    """
    known = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = dict(known.groupBy(lang_col).count().collect())
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 30)) < share * (1 << 30)).select(lang_col, text_col)

    def measured(batches):
        for batch in batches:
            got = [text_features(t) for t in as_bytes(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([batch.column(lang_col), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["lang", "at", "value"])

    rows = chosen.mapInArrow(measured, "lang string, at binary, value binary").collect()
    return LanguageModel([(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in sorted(rows, key=lambda r: (r[0], r[1]))])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only the text is read.

    lang_pred is `und` with score 0 for null texts, texts without a letter, and a model that knows no language. Repeated rows
    and null ids stay; an empty table gives an empty result. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: list[WordIndex] = []

    def described(words):
        plain, letters = _plain(words)
        ids, lengths = gram_ids([w if ok else b"" for w, ok in zip(plain, letters, strict=True)], GRAMS, DIMS)
        weights = sent.value.weights[:, :DIMS].T
        return sums(weights[ids], lengths) * letters[:, None], letters, np.where(letters, lengths, 0)

    def told(batches):
        if not state:
            state.append(WordIndex(described))
        for s in slices(batches, text_col):
            numbers, (scores, letters, grams) = state[0](as_bytes(s.column(text_col)))
            m = sent.value
            margins, known = np.zeros((len(numbers), len(m.weights))), np.zeros(len(numbers), bool)
            for i, x in enumerate(numbers):
                margins[i] = SCALE * scores[x].sum(axis=0) / max(1, grams[x].sum()) + m.weights[:, DIMS]
                known[i] = letters[x].any()
            best, score = m.decide(margins) if m.langs and len(numbers) else (np.zeros(len(numbers), int), np.zeros(len(numbers)))
            known &= bool(m.langs)
            yield pa.RecordBatch.from_arrays([s.column(id_col), pa.array([m.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0))], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(told, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
