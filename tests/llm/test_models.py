"""Operators 3, 5, 8 and 9 against plain forms of their rules, and the pipeline's stages against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import _linear, decontaminate, language, quality, queries, toxicity
from palimpsest.llm._shared import remainder, slices
from palimpsest.llm._words import WordIndex, mixed
from tests.llm.test_text_operators import classes_by_hand, removed_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_margins_are_those_of_whole_texts(spark, docs):
    model = language.fit(docs.filter(remainder("doc_id", 4) != 2), per_language=40)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    for r in docs.limit(60).collect():
        at, value = language.text_features((r.text or "").encode())
        if not len(at):
            continue
        margins = model.weights[:, at] @ value.astype(float) + model.weights[:, language.DIMS]
        best, score = model.decide(margins[None, :])
        assert got[r.doc_id][0] == model.langs[best[0]] and abs(got[r.doc_id][1] - score[0]) < 1e-4


def test_votes_decide_within_the_family():
    rows = [(lang, np.array([i]), np.array([8.0])) for lang, i in (("en", 0), ("de", 1), ("fr", 2), ("es", 3)) for _ in range(5)]
    model = language.LanguageModel(rows)
    assert {(model.langs[a], model.langs[b]) for a, b in model.pairs} == {("de", "en"), ("es", "fr")}
    margins = np.array([model.weights[:, i] * 8.0 + model.weights[:, language.DIMS] for i in range(4)])
    assert [model.langs[b] for b in model.decide(margins)[0]] == ["en", "de", "fr", "es"]


def features_by_hand(text, terms):
    words = text.split()
    n = len(words)
    out = dict.fromkeys(toxicity.FEATURES, 0.0)
    if not n:
        return out
    fixed, learned, you, odds = [], [], [], []
    for i, w in enumerate(words):
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
        inside = (not bare.isalpha() and bool(re.search(r"[^\W\d_][\d@$!*#.\-]+[^\W\d_]", w))) or bool(re.search(r"(.)\1\1+", bare))
        plain = re.sub(r"(.)\1\1+", r"\1", bare.translate(str.maketrans("013457@$!*", "oieastasi\0"))) if inside else bare
        known = max((terms.get(t, 0.0) for t in toxicity.terms_of(bare)), default=0.0)
        fixed += [i] if plain in toxicity.INSULTS or bare in toxicity.INSULTS else []
        learned += [i] if known > 0 else []
        odds.append(known)
        you += [i] if bare in toxicity.SECOND else []
        out["capitals"] += (w.isupper() and sum(map(str.isalpha, w)) > 1) / n
        out["titles"] += w[:1].isupper() / n
        out["exclamations"] += w.count("!") / n
        out["questions"] += w.count("?") / n
        out["punctuation"] += sum(not c.isalnum() for c in w) / n
        out["obfuscated"] += inside / n
        out["word_length"] += len(w.encode()) / n
    marked = sorted({*fixed, *learned})
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in marked)
    return out | {
        "log_words": math.log1p(n), "fixed_density": len(fixed) / n, "fixed_count": len(fixed), "learned_density": len(learned) / n, "learned_count": len(learned),
        "log_odds_sum": sum(odds), "log_odds_max": max(odds), "near_second": near / n, "second_density": len(you) / n,
    }


def test_toxicity_features(docs):
    terms = {"heed-": 1.5, "tion": 2.0, "inhe-": 0.7}
    texts = [r.text or "" for r in docs.limit(80).collect()] + ["You id10t!!! go, YOU stuuuupid F.o.o.l?", "", "heeding you tion TION a_b"]
    got = toxicity.features(WordIndex(toxicity._Words(terms)), [t.encode() for t in texts])
    want = np.array([[features_by_hand(t, terms)[f] for f in toxicity.FEATURES] for t in texts])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def test_trees_leaf_by_leaf():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = toxicity.Trees(x, y, trees=25)
    assert ((trees.margins(x) > 0) == (y > 0)).mean() > 0.9
    for row in rng.normal(size=(30, 4)):
        total = trees.start
        for splits, values, depth in trees.trees:
            node = 0
            for level in range(depth):
                j, cut = splits[level, node]
                node = 2 * node + (j is not None and np.searchsorted(trees.cuts[j], row[j], side="left") > cut)
            total += trees.rate * values[node]
        assert abs(total - trees.margins(row[None, :])[0]) < 1e-9


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(3)
    x, y = rng.permutation(40).astype(float), (rng.random(40) < 0.5).astype(float)
    at, value = toxicity.isotonic(x, y)
    order = np.argsort(x)
    z = y[order]
    fit = np.array([max(min(z[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)])
    sizes = np.array([(fit == f).sum() for f in fit])
    drawn = (fit * sizes + y.mean()) / (sizes + 1)
    assert np.allclose(np.interp(x[order], at, value), drawn)


def test_quality_indicators(docs):
    texts = [(r.text or "").encode() for r in docs.limit(25).collect()] + [b"", b"one", b"A b a b Cd-1! e"]
    flags = quality.indicators(texts)
    for text, got in zip(texts, flags, strict=True):
        words = text.split()
        w, shapes = quality._described(words) if words else (np.empty(0, np.uint64), np.empty(0, np.uint64))
        far = []
        for i in range(len(words)):
            d = next((d for d in range(1, 17) if i - d >= 1 and words[i] == words[i - d] and words[i - 1] == words[i - d - 1]), 0)
            far.append(d)
        shape = shapes + np.array(far, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        want = {int(h) for h in mixed(w) & np.uint64(quality.DIMS - 1)} | {int(h) for h in mixed(shape) & np.uint64(quality.DIMS - 1)}
        for n, odd in ((2, 3), (3, 5)):
            for i in range(len(words) - n + 1):
                acc = np.array([odd], np.uint64)
                for k in range(n):
                    acc = mixed(acc + shape[i + k : i + k + 1])
                want.add(int(mixed(acc)[0] & np.uint64(quality.DIMS - 1)))
        assert set(np.flatnonzero(got).tolist()) == want


def test_dual_coordinate_descent_reaches_the_least_loss():
    rng = np.random.default_rng(7)
    x, cost = rng.normal(size=(40, 3)), rng.uniform(0.2, 2, 40)
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 * rng.normal(size=40) > 0, 1.0, -1.0)
    w = _linear.dual_coordinate_descent([(np.arange(3), r) for r in x], y, 3, cost, epochs=3000)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v[:3] + v[3]))).sum()
    best = loss(w)
    assert all(loss(w + d) >= best - 1e-3 for d in rng.normal(size=(4000, 4)) * rng.choice([1e-3, 1e-2, 0.1, 1], size=(4000, 1)))


def test_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["", None, "abc", "x" * 50, "y" * 5, ""] * 40})
    parts = list(slices(iter([batch]), "text", 60, 7))
    assert sum(p.num_rows for p in parts) == batch.num_rows and max(p.num_rows for p in parts) <= 7
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()


def contaminated_by_hand(text, items, window=8):
    """Items that stand in a text word for word, or with every number changed in the same way throughout."""
    words, out = text.split(), set()
    for key, item in items.items():
        want = item.split()
        for i in range(len(words) - len(want) + 1):
            part = words[i : i + len(want)]
            slots = defaultdict(set)
            same = all(a == b or (a.isdigit() and b.isdigit()) for a, b in zip(want, part, strict=True))
            for a, b in zip(want, part, strict=True):
                if a.isdigit():
                    slots[a].add(b)
            if same and all(len(s) == 1 for s in slots.values()):
                out.add(key)
    return out


def test_decontamination_of_planted_templates(spark):
    rng = random.Random(13)
    vocabulary = [f"{a}{b}" for a in ("kal", "mer", "tos", "vin", "dro", "pes") for b in ("a", "en", "ik", "or", "um", "ys", "el")]
    items = {k: " ".join(rng.choice(vocabulary) if rng.random() < 0.75 else str(rng.randrange(4, 9)) for _ in range(rng.randrange(14, 40))) for k in range(30)}
    rows = []
    for k in range(200):
        filler = lambda n: [rng.choice(vocabulary) for _ in range(rng.randrange(n))]
        kind, item = k % 4, items[rng.randrange(30)].split()
        if kind == 1:
            shift = rng.randrange(10, 90)
            item = [str(int(w) + shift) if w.isdigit() else w for w in item]
        elif kind == 2:
            item = filler(40)
        elif kind == 3:
            rng.shuffle(item)
        rows.append((k, " ".join([*filler(60), *item, *filler(60)])))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = defaultdict(set)
    for r in decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect():
        got[r.doc_id].add(r.item_id)
    for k, text in rows:
        want = contaminated_by_hand(text, items)
        assert want <= got[k], (k, want, got[k])
        assert k % 4 < 2 or got[k] == want


def test_stages_against_brute_force(spark, docs):
    """What each filtering stage keeps of its own input, told without the operator."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    held = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, SF).filter("predicted = 1").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in held.items()], columns)
        kept = {r.doc_id: r.text for r in stage(spark, rows, SF).collect()}
        if name == "toxicity":
            want = {k: t for k, t in held.items() if k not in toxic}
        elif name == "near_dedup":
            classes = classes_by_hand([(k, t) for k, t in held.items() if t is not None])
            want = {k: t for k, t in held.items() if t is None or classes[k] == k}
        elif name == "substring_dedup":
            told = removed_by_hand(list(held.items()))
            want = {k: told[k][2] if told[k][1] else t for k, t in held.items() if not told[k][1] or told[k][1] < told[k][0]}
        else:
            verbatim = {k for k, t in held.items() if any(i in (t or "") for i in items)}
            assert not verbatim & kept.keys() and len(held) - len(kept) <= 2 * len(verbatim) + 2
            want = {k: held[k] for k in kept}
        assert kept == want
        held = kept


def test_contamination_by_items_that_share_their_windows(spark, tmp_path):
    """Of many alike items each counts, not only the first: documents whose values fit another one, or with an edited passage, go."""
    words = [f"story{k}" for k in range(40)]
    alike = [f"the farmer had {i + 10} sheep and then bought {i + 90 if i % 2 else i + 10} more sheep before the long winter came" for i in range(30)]
    items = alike + [" ".join([*words, f"ask{i}", f"why{i}", f"now{i}"]) for i in range(30)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    edited = " ".join([*words[:19], "odd", *words[20:34], "odd", *words[35:], "ask7", "why7", "now7"])
    texts = [alike[7], edited, " ".join(words), " ".join(words[:20]), alike[6].replace("had 16", "had 5"), None, items[0]]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [3, 5]


def shared_families(n):
    """n items of each of three kinds that differ only where a window cannot tell: in a last word, in a tail, in poor windows."""
    words = [f"story{k}" for k in range(40)]
    out = [" ".join([*(f"tale{k}" for k in range(24)), f"end{i}"]) for i in range(n)]
    out += [" ".join([*words, f"ask{i}", f"why{i}", f"now{i}"]) for i in range(n)]
    return out + [f"the farmer had many sheep and sold them for {' '.join(str(i + 40 * k) for k in range(1, 9))} dollars" for i in range(n)]


@pytest.mark.parametrize("n", [20, 21, 60])
def test_contamination_whatever_number_of_items_share_it(spark, tmp_path, n):
    """A document goes for what it holds of an item, if one has it or sixty: 24 words of 25, edited passages, other numbers."""
    spark.createDataFrame(list(enumerate(shared_families(n))), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = [f"story{k}" for k in range(40)]
    texts = [" ".join([*(f"tale{k}" for k in range(24)), "other"]), " ".join([*words[:19], "odd", *words[20:34], "odd", *words[35:]]), "the farmer had many sheep and sold them for 5 6 7 8 9 11 12 13 dollars"]
    texts += [" ".join(words[:20]), "tale0 tale1 tale2 tale3 tale4 tale5 tale6 tale7 tale8 and no more", "the farmer had many sheep and kept them", None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [3, 4, 5, 6]


@pytest.mark.parametrize("n", [20, 21, 60])
def test_op3_tells_items_whatever_number_share_them(spark, tmp_path, n):
    """op3 gives each item of a family that a document holds enough of, if the family has twenty items or sixty; half a line is none."""
    spark.createDataFrame(list(enumerate(shared_families(n))), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = [f"story{k}" for k in range(40)]
    texts = [" ".join([*(f"tale{k}" for k in range(24)), "other"]), " ".join([*words[:19], "odd", *words[20:34], "odd", *words[35:]]), "the farmer had many sheep and sold them for 5 6 7 8 9 11 12 13 dollars"]
    texts += [" ".join(words[:20]), "the farmer had many sheep and kept them", None, " ".join([*words[:34], "ask3", "why3", "now3"])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, str(tmp_path)).collect())
    assert got == [(d, f * n + i) for d, f in ((0, 0), (1, 1), (2, 2), (6, 1)) for i in range(n)]


def test_shared_windows_lead_to_what_windows_of_few_items_do(monkeypatch):
    """Random families of items: the same documents are told as if no window were common, at any bound on the pairs held."""
    for seed in range(4):
        rng = random.Random(seed)
        word = lambda: rng.choice([f"w{rng.randrange(60)}", f"w{rng.randrange(60)}", str(rng.randrange(5)), rng.choice(["Anna", "Bert", "Carl"])])
        stems = [[word() for _ in range(rng.randrange(9, 50))] for _ in range(4)]
        edited = lambda x, k: [word() if rng.random() < k else w for w in x]
        items = [" ".join([*edited(rng.choice(stems), 0.03), *(word() for _ in range(rng.randrange(8)))]) for _ in range(240)]
        texts = []
        for k in range(60):
            source = rng.choice(items).split() if k % 2 else rng.choice(stems)
            part = edited(source[rng.randrange(1 + len(source) // 2) :], rng.choice([0, 0.05, 0.15]))
            texts.append(" ".join([*(word() for _ in range(rng.randrange(9))), *part, *part[: rng.randrange(20)], *(word() for _ in range(9))]).encode())
        told = {}
        for common, pairs in ((10**9, 1 << 20), (20, 1 << 20), (20, 50)):
            monkeypatch.setattr(decontaminate, "SHARED", common)
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            block = decontaminate.Block(list(enumerate(items)))
            assert bool(block.common) == (common == 20)
            told[common, pairs] = [{(r[0], r[1]) for r in block.matches(texts, 0.5, 0.8, once=once, shared=True)} for once in (False, True)]
        every = told[10**9, 1 << 20][0]
        assert len({t for t, _ in every}) > 20
        for each, first in told.values():
            assert each == every and first <= every and {t for t, _ in first} == {t for t, _ in every}


def test_pipeline_ignores_columns_of_its_own_names(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13, 9, "x", 0.5), (2, "a b c d e f g", "en", "s", 13, 9, "x", 0.5), (3, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, class_id string, score double")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        assert out.count() == (2 if k == 1 else 3)
