"""Operators 11, 12 and 13 against plain Python, and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import codes, importance, mixing, queries
from palimpsest.llm._shared import join_back

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, lang string, size string, weight string, score string, copies string, key string, row string, rank string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "w", "x", "y", "z", "k", "r", "q") for i, t, s in rows], SCHEMA)


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# operator 11


def drawn_by_hand(rows, target, percent=10, least=20, n=1, buckets=10_000, seed=2024):
    def feats(text):
        w = low_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(f for text in texts for f in feats(text)) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, able = [], []
    for i, text in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, feats(text)))
        row = [i, len(feats(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(low_words(text)) >= least:
            able.append(row)
    for place, row in enumerate(sorted(able, key=lambda r: (-r[3], r[0]))[: percent * len(able) // 100], 1):
        row[4] = place
    return sorted(map(tuple, out), key=repr)


def as_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def test_importance_whole_table(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = drawn_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert as_rows(queries.op11_importance(spark, SF), "doc_id", "n_features", "weight", "score", "rank") == want
    assert sum(r[4] is not None for r in want) > 50


@pytest.mark.parametrize("n", [1, 3])
def test_importance_odd_texts(spark, n, monkeypatch):
    monkeypatch.setattr("palimpsest.llm._words.pieces.__defaults__", (500,))  # texts in many pieces
    long = " ".join(f"word{k % 700} É{k}" for k in range(3000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " !\t,", "a"), (4, long, "a"), (5, long, "b"), (6, "The cat-the CAT", "b"), (7, "x" * 2000, None), (8, "a\x00b\x7fc ÀÈ àè 字字" * 9, "c"), (9, "same " * 25, "c"), (10, "same " * 25, "c"), (11, long + " tail", "c")]
    target = ["the cat", None, "same same word1", "é"]
    got = importance.resample(odd(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id int, text string"), percent=50, n=n)
    assert as_rows(got, "doc_id", "n_features", "weight", "score", "rank") == drawn_by_hand([r[:2] for r in rows], target, 50, n=n)


def test_importance_empty_and_repeated(spark):
    none, target = odd(spark, []), odd(spark, [(1, "a b", "s")])
    assert importance.resample(none, target).count() == 0
    rows = [(1, "a b c " * 10, "s")] * 3 + [(None, "a b c " * 10, "s"), (2, "d " * 30, "s")]
    got = as_rows(importance.resample(odd(spark, rows), none, percent=40), "doc_id", "n_features", "weight", "score", "rank")
    assert [r[0] for r in got] == [1, 1, 1, 2, None] and sorted(r[4] for r in got if r[4]) == [1, 2]
    assert len({r[3] for r in got if r[0] == 1}) == 1


def test_long_text_is_counted_whole():
    text = b" ".join(b"w%d" % (k % 50_000) for k in range(1_500_000))
    found, words = importance.text_features(text, 1, 10_000)
    assert words == 1_500_000 == found[:, 1].sum() and len(text) > 8_000_000


def test_join_back_with_hot_groups(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2000).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    got = join_back(rows, groups, "k", "n", 5000)
    want = defaultdict(int)
    for r in rows.collect():
        want[r.k] += r.id
    assert {(r.id, r.k, r.s) for r in got.collect()} == {(r.id, r.k, want[r.k]) for r in rows.collect()} and got.count() == 5000


# operator 12


def coded_by_hand(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = sorted((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    points = {i: [math.floor(scale * x) for x in v] for i, v, _ in kept}
    cut = lambda v, p: v[p * len(v) // parts : (p + 1) * len(v) // parts]
    books = [[cut(points[i], p) for i, _, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for v in points.values():
                of[nearest(p, cut(v, p))].append(cut(v, p))
            for e, vs in of.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    codes_of = {i: [nearest(p, cut(v, p)) for p in range(parts)] for i, v in points.items()}
    error = {i: sum(far(cut(v, p), books[p][codes_of[i][p]]) for p in range(parts)) for i, v in points.items()}
    by_label = defaultdict(int)
    for i, _, label in kept:
        by_label[label] += error[i]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in codes_of[i]), error[i], by_label[label], digest) for i, _, label in kept), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error string")


def all_columns(vecs, **more):
    coded, books = codes.compress(vecs, **more)
    return as_rows(codes.with_label_error(coded).withColumn("books", F.lit(codes.digest(books))), "vec_id", "code", "error", "label_error", "books")


def test_codes_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert as_rows(queries.op12_vector_codes(spark, SF), "vec_id", "code", "error", "label_error", "codebooks_sha256") == coded_by_hand(rows)


@pytest.mark.parametrize("scale", [256, 1 << 26])
def test_codes_odd_vectors(spark, monkeypatch, scale):
    """Ties, copies, wide numbers, dropped rows, labels without a value, several blocks a task."""
    monkeypatch.setattr(codes, "BLOCK_VALUES", 200)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 8], int(rng.integers(3)) if i % 4 else None) for i in range(150)]
    rows += [(200, None, 1), (201, [0.5] * 7 + [None], 1), (202, [0.5] * 7 + [math.nan], 1), (203, [math.inf] * 8, None), (204, [0.0] * 8, None), (205, [-0.125] * 8, 9)]
    assert all_columns(vectors(spark, rows), parts=4, entries=10, scale=scale) == coded_by_hand(rows, 4, 10, scale=scale)


def test_codes_few_none_and_wrong(spark):
    few = [(5, [0.1, 0.2], 1), (3, [0.3, -0.2], None), (3, [0.3, -0.2], None)]
    got = all_columns(vectors(spark, few), parts=2)
    assert [(r[0], r[1], r[2]) for r in got] == [(3, "0000", 0), (3, "0000", 0), (5, "0202", 0)]
    assert all_columns(vectors(spark, [])) == [] == all_columns(vectors(spark, [(1, None, 1)]))
    huge = all_columns(vectors(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 3.0], 1), (None, [0.0, 0.0], 2)]), parts=2, entries=1)
    assert [r[0] for r in huge] == [1, 2, None] and huge[0][2] is None
    with pytest.raises(Exception, match="multiple of"):
        all_columns(vectors(spark, [(1, [0.1, 0.2, 0.3], 1)]), parts=2)


def test_filtering_opens_few_points():
    """Whole subtrees are assigned: where points lie in clumps, none is compared one by one; elsewhere the codes stay exact."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-10_000, 10_000, (16, 4))
    points = (centres[rng.integers(0, 16, 4096)] + rng.integers(-5, 6, (4096, 4))).astype(np.int64)
    tree = codes._load(codes._dump(codes.build(points)), 4)
    counts, sums, told, opened = codes.assign(tree, centres, codes=True)
    want = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (told == want).all() and (counts == np.bincount(want, minlength=16)).all() and (sums.sum(0) == points.sum(0)).all()
    assert opened < 600


# operator 13


def mixed_by_hand(rows, weights=(1, 2, 3), percent=100, most=3, seed=2024):
    """Targets by sharing the excess again and again; then words are served one queue after another up to the target."""
    size = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    total = Counter()
    for _, n, s in size:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, fixed = sum(total.values()) * percent // 100, {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = budget - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] > most * total[s] * w]
        if not over:
            goal = fixed | {s: left * weight[s] / w for s in free}
            break
        fixed |= {s: float(most * total[s]) for s in over}
    return {s: (total[s], goal[s]) for s in names}, size


@pytest.mark.parametrize("percent", [100, 30, 170])
def test_mixing_targets_and_words(spark, percent):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t, None if s == "src3" else "ä" if s == "src4" else s) for i, t, s in rows]
    goals, size = mixed_by_hand(rows, percent=percent)
    got = mixing.taken(mixing.mix(odd(spark, rows), percent=percent)).collect()
    of = {i: s for i, _, s in size}
    given = Counter()
    assert sorted(r.doc_id for r in got) == sorted(of) and {r.doc_id: r.size for r in got} == {i: n for i, n, _ in size}
    for r in got:
        total, goal = goals[of[r.doc_id]]
        assert r.source_size == total and r.target == pytest.approx(goal) and 0 <= r.taken <= 3 * r.size
        given[of[r.doc_id]] += r.taken
    assert sum(given.values()) == sum(n for _, n, _ in size) * percent // 100
    assert all(abs(given[s] - goal) <= len(goals) for s, (_, goal) in goals.items())


def test_mixing_is_stable_and_ordered(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, again = (mixing.mix(d).collect() for d in (docs, docs.repartition(5, "text")))
    key = lambda r: (r.doc_id, r.copy, r.words, r.position)
    assert sorted(map(key, first)) == sorted(map(key, again))
    taken = sorted((r for r in first if r.words), key=lambda r: r.position)
    assert [r.position for r in taken] == list(np.cumsum([0] + [r.words for r in taken[:-1]])) and [r.finish for r in taken] == sorted(r.finish for r in taken)


def test_mixing_odd_rows(spark):
    text = "\x0b a\tb \x0c c d\x1ce "
    rows = [(1, text, "a"), (1, text, "a"), (2, None, "a"), (3, "", None), (None, "x y", None), (4, " \t\n", "empty"), (5, "one " * 50, "big"), (6, "long " * 400_000, "big")]
    got = as_rows(mixing.taken(mixing.mix(odd(spark, rows))), "doc_id", "size", "source_size", "taken")
    goals, size = mixed_by_hand(rows)
    assert sorted((r[0] or 0, r[1]) for r in got) == sorted((i or 0, n) for i, n, _ in size)
    assert sum(r[3] for r in got) == sum(n for _, n, _ in size)
    assert mixing.mix(odd(spark, [])).count() == 0
    blank = mixing.taken(mixing.mix(odd(spark, [(1, None, "a"), (2, " ", None)]))).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
