"""Operators 2, 3, 5, 8, 9 and 10 against brute force and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, language, near_dedup, quality, queries, substring, toxicity
from palimpsest.llm._shared import remainder

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, n_words string, _bucket string, score string, class_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "c") for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed_by_hand(rows, n=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        w = words(text)
        gone = set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone.update(range(k, k + n))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_whole_table(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_substring_dedup(spark, SF).collect()}
    want = removed_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in want.items()}
    assert sum(v[1] for v in got.values()) > 0


def test_substring_odd_texts(spark):
    rng = random.Random(7)
    few = [str(rng.randrange(3)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, " ".join(few)), (5, "a " * 300), (6, " ".join(few[50:120]) + " x " + " ".join(few[10:60])), (7, "a b " * 25), (8, "b " * 19), (9, "b " * 20), (10, "b " * 21), (11, " ".join(f"w{k}" for k in range(5000))), (12, " ".join(f"w{k}" for k in range(4000, 4030)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(odd(spark, rows)).collect()}
    assert got == removed_by_hand(rows)
    twice = substring.remove_repeats(odd(spark, [(1, "c d " * 20), (1, "c d " * 20), (None, "c d " * 20)])).collect()
    assert sorted(r.n_words - r.n_removed for r in twice)[:2] == [0, 0] and sum(r.n_removed == r.n_words for r in twice) == 2
    assert substring.remove_repeats(odd(spark, [])).count() == 0


def test_suffix_groups_follow_prefixes():
    counts = [np.array([3, 50, 2, 0]), np.array([20, 4, 0, 9]), np.array([100, 1, 1, 1])]
    one, two, last = substring.plan_groups(counts, 10)
    assert one[1] == -1 and two[0] == -1 and (last >= 0).all() and len({*one, *two, *last} - {-1}) >= 3
    for level, c in ((one, counts[0]), (two, counts[1])):
        for g in set(level) - {-1}:
            assert c[level == g].sum() <= 20
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(4)) for _ in range(3000)).encode()
    words_, _ = substring.hashed([text])
    for level, cells in enumerate(substring.prefix_cells(words_, 20, 16)):
        n = (*substring.PREFIXES, 20)[level]
        by_text = defaultdict(set)
        w = text.split()
        for i, c in enumerate(cells.tolist()):
            by_text[tuple(w[i : i + n])].add(c)
        assert all(len(x) == 1 for x in by_text.values())


def test_deep_nodes_of_a_subtree():
    rng = np.random.default_rng(4)
    labels, more = rng.integers(0, 6, 80).astype(np.uint64), rng.integers(0, 2, 80).astype(np.uint32)
    known, keys = rng.integers(0, 2, 80).astype(np.uint8), rng.integers(-3, 4, 80)
    order, begins = substring.deep_nodes(labels, more, known, keys)
    leaves = defaultdict(list)
    for i in range(80):
        leaves[labels[i], more[i]].append((known[i], keys[i], i))
    got = {(labels[order[a]], more[order[a]]): [(known[i], keys[i], i) for i in order[a:b]] for a, b in zip(begins, [*begins[1:], 80], strict=True)}
    assert got == {k: sorted(v) for k, v in leaves.items()}


def test_substring_groups_of_every_prefix_length(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(15, 120)))) for i in range(60)]
    want = removed_by_hand(rows)
    for most in (1, 40, 100_000):
        monkeypatch.setattr(substring, "GROUP_SUFFIXES", most)
        got = substring.remove_repeats(odd(spark, rows)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
        for r in got:
            assert sum(s.length for s in r.spans) == r.n_removed and all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_substring_null_ids_are_not_the_least_number(spark):
    rows = [(None, "c d " * 20), (-(2**63), "c d " * 20), (5, "c d " * 20)]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(odd(spark, rows)).collect()}
    assert got == {None: 38, -(2**63): 40, 5: 40}


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes_by_hand(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen, sets, where = {}, {}, defaultdict(list)
    for i, text in sorted(rows):
        if text in seen:
            parent[root(i)] = root(seen[text])
            continue
        seen[text] = i
        met = defaultdict(int)
        sets[i] = shingle_set(text)
        for s in sets[i]:
            for j in where[s]:
                met[j] += 1
            where[s].append(i)
        for j, both in met.items():
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in rows}


def test_near_duplicates_whole_table(spark, docs):
    rows = queries.op2_near_dedup(spark, SF).collect()
    want = classes_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.class_id for r in rows} == want
    assert {r.doc_id for r in rows if r.keep} == {i for i, c in want.items() if i == c}


def test_near_duplicates_large_groups_and_chains(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(100 + k, " ".join([*base[:k % 190], f"new{k}", *base[k % 190 + 1 :]])) for k in range(60)]
    chain = base[::-1]
    for k in range(8):  # neighbours are alike, ends are not
        chain = [*chain[10:], *(f"c{k}_{j}" for j in range(10))]
        rows.append((300 + k, " ".join(chain)))
    rows += [(1, ""), (2, ""), (4, "one two"), (5, "one two"), (6, "two one")]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(odd(spark, rows)).collect()}
    assert got == classes_by_hand(rows)
    nulls = near_dedup.near_duplicates(odd(spark, [(1, None), (2, None), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_in_class, r.keep) for r in nulls)[:2] == [("1", "1", 1, True), ("2", "2", 1, True)]
    assert sum(r.keep for r in nulls) == 3 and sum(r.class_id == 3 for r in nulls) == 3
    assert near_dedup.near_duplicates(odd(spark, [])).count() == 0


def test_near_duplicates_in_a_bucket_without_a_hub(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "sketch", lambda docs, id_col, text_col, *_: one_bucket(docs, id_col, text_col))
    rng = random.Random(11)
    rows = []
    for k in range(25):  # 25 pairs on one template, each alike only within itself
        own = [f"o{k}_{j}" for j in range(60)]
        rows += [(2 * k, " ".join([*(f"t{j}" for j in range(60)), *own])), (2 * k + 1, " ".join([*(f"t{j}" for j in range(60)), *own[:-3], f"x{k}"]))]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(odd(spark, rows)).collect()}
    assert got == classes_by_hand(rows) and len(set(got.values())) == 25
    monkeypatch.setattr(near_dedup, "SALTED", 2)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(odd(spark, rows)).collect()} == got


def test_near_duplicates_with_repeated_blocks(spark):
    own, block = " ".join(f"w{k}" for k in range(50)), "a b c d e f g "
    rows = odd(spark, [(1, f"{own} {block * 3}"), (2, f"{own} {block * 100}")])
    one, other = (r.bands for r in near_dedup.sketch(rows).orderBy("_id").collect())
    assert one == other
    assert {r.class_id for r in near_dedup.near_duplicates(rows).collect()} == {1}


def one_bucket(docs, id_col, text_col):
    """The sketch of a table whose texts all meet in one band and nowhere else."""
    n = F.udf(lambda t: len(shingle_set(t)), "long")
    return docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("node"), n(text_col).alias("n_shingles"), F.array(F.lit(1).cast("long")).alias("bands"))


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    ids = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    x, y = a / a.sum(), b / b.sum()
    true = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(300))
    both = near_dedup.probminhash(np.repeat([0, 1], 300), np.concatenate([ids, ids]), np.concatenate([a, b]), 2, 4096)
    assert abs((both[0] == both[1]).mean() - true) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (101, 103)], "a long, b long")
    got = {r["node"]: r["class"] for r in near_dedup.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 104)}}


def test_decontamination_finds_word_for_word_passages(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, t in items.items() if t in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, SF).collect()}
    assert whole and whole <= got and len(got - whole) <= 0.1 * len(whole)


def test_decontamination_of_changed_questions(spark):
    item = "Alice buys 12 apples for 3 dollars each and gives Bob half of all the apples that she bought then Alice has how many apples left"
    other = "Carol buys 40 apples for 5 dollars each and gives Dave half of all the apples that she bought then Carol has how many apples left"
    mixed = "Carol buys 40 apples for 5 dollars each and gives Dave half of all the apples that she bought then Erik has how many apples left"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id int, text string")
    rows = [(1, "so " + other + " indeed"), (2, "nothing of that kind is said in this text at all, 12 apples or not"), (3, None), (4, ""), (5, "too short"), (6, item.upper()), (None, item)]
    got = {r.doc_id for r in decontaminate.find_contamination(odd(spark, rows), bench, agreement=1.0).collect()}
    assert got >= {1, None, 5} and not got & {2, 3, 4}  # an item of two words is found as it is written
    assert not decontaminate.find_contamination(odd(spark, [(1, mixed)]), bench, agreement=1.0).collect()
    assert decontaminate.find_contamination(odd(spark, []), bench).count() == 0
    assert decontaminate.find_contamination(odd(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_poor_and_short_items(spark):
    """Items of little but placeholders, of one and two words, with units and names; equality, not a superset."""
    items = [(0, "In 1999 Paris had 12 km"), (1, "prove it"), (2, "Capital Paris"), (3, "Anna sold 12 kg of Maple sugar for 30 dollars in May"), (4, "7 8 9"), (5, "walls")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "so In 2003 London had 15 km of road"), (2, "In 1999 Paris had 12 km"), (3, "In 2003 London lost 15 km"), (4, "please prove it now"), (5, "prove that it holds"), (6, "the Capital Paris is big"),
        (7, "the Capital London is big"), (8, "yes. Tom Reed sold 99 kg of Birch sugar for 5 dollars in June, yes"), (9, "Tom sold 99 bags of Birch bark for 5 coins in June"), (10, "and 7 8 9 too"), (11, "and 1 2 3 too"), (12, "four walls"),
    ]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_contamination(odd(spark, rows), bench).collect())
    assert got == [(1, 0), (2, 0), (4, 1), (6, 2), (8, 3), (10, 4), (12, 5)]


def test_decontamination_shared_lines(spark):
    """A line that many items share says nothing of them; a passage that they share is told once, an item of its own by itself."""
    line = "answer the following question as well as you can in words"
    passage = " ".join(f"story{k}" for k in range(40))
    items = [(i, f"{line} what is thing{i} of kind{i}") for i in range(3000)] + [(5000 + i, f"{passage} ask{i} why{i} now{i}") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, line), (2, items[7][1]), (3, passage), (4, f"{line} what is thing9 for others"), (5, items[3009][1])]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_contamination(odd(spark, rows), bench).collect())
    assert [g for g in got if g[0] in (1, 2, 3)] == [(2, 7), (3, 5000)] and (5, 5009) in got and len([g for g in got if g[0] == 5]) <= 2


def test_decontamination_tells_all_items_of_shared_windows(spark, monkeypatch):
    """Windows of more than SHARED items lead to each item: alike ones, one with an edited passage, one whose values alone fit."""
    alike = [(i, f"the farmer had {i + 10} sheep and then bought {i + 90 if i % 2 else i + 10} more sheep before the long winter came") for i in range(30)]
    words = [f"story{k}" for k in range(40)]
    tails = [(100 + i, " ".join([*words, f"ask{i}", f"why{i}", f"now{i}"])) for i in range(30)]
    long = "when {} met {} at the old stone bridge near the river they spoke about the weather and the harvest and about many other small things of the year until {} went home through the dark woods again"
    named = [(200 + i, long.format("Anna", "Bert", "Anna" if i < 29 else "Bert") + f" tell{i} why{i}") for i in range(30)]
    bench = spark.createDataFrame([(i, t) for i, t in alike + tails + named] + [(300, tails[0][1])], "item_id long, text string")
    edited = " ".join([*words[:19], "odd", *words[20:34], "odd", *words[35:], "ask7", "why7", "now7"])
    rows = [(1, f"so {alike[7][1]} we read"), (2, " ".join(words)), (3, edited), (4, long.format("Carl", "Dora", "Dora")), (5, " ".join(words[:20])), (6, alike[6][1].replace("16", "8"))]

    def told(once):
        return sorted((r.doc_id, r.item_id) for r in decontaminate.find_contamination(odd(spark, rows), bench, once=once).collect())

    every = told(False)
    assert every == sorted([*((1, i) for i in range(1, 30, 2)), *((2, i) for i in (*range(100, 130), 300)), (3, 107), (4, 229), *((6, i) for i in range(30))])
    assert told(True) == [(1, 1), (2, 100), (2, 300), (3, 107), (4, 229), (6, 0)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert told(False) == every and {d for d, _ in told(True)} == {1, 2, 3, 4, 6}


def test_decontamination_by_occurrence(spark):
    item = "Alice buys 12 apples for 3 dollars each and gives Bob half of all the apples that she bought then Alice has how many apples left"
    other = item.replace("Alice", "Carol").replace("12", "40").replace("3", "5").replace("Bob", "Dave")
    sums = "7 12 19 33 48 51 67 82 90 104"
    bench = spark.createDataFrame([(1, item), (2, sums), (3, "Is 17 prime")], "item_id int, text string")
    rows = [(1, f"{item} so we ask again {other}"), (2, f"the list {sums} was read"), (3, "the list 8 13 20 34 49 52 68 83 91 105 was read"), (4, "we asked: Is 17 prime ?"), (5, "we asked: Is 18 prime ?")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(odd(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 2), (4, 3)}


def test_language_held_out(spark, docs):
    got = queries.op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_texts(spark, docs):
    model = language.fit(docs.filter(remainder("doc_id", 4) != 2), per_language=60)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd(spark, [(1, None), (2, ""), (3, "12 34 |"), (4, "der die das und nicht schon " * 3000)]), model).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "de"
    none = language.fit(docs.limit(0))
    assert language.identify(odd(spark, [(1, "the text")]), none).first().lang_pred == "und"
    one = language.fit(docs.filter("lang = 'en'").limit(5))
    assert language.identify(odd(spark, [(1, "the text")]), one).first().lang_pred == "en"


def area(pairs):
    s, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    return float(np.mean([(s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])]))


@pytest.mark.parametrize(("query", "label", "least"), [("op8_toxicity", "toxic", 0.85), ("op9_quality", "quality", 0.95)])
def test_labels_held_out(spark, query, label, least):
    rows = getattr(queries, query)(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert area([(r.score, r[label]) for r in rows]) > least
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_inputs(spark, docs, module):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = odd(spark, [(1, None), (2, ""), (2, ""), (None, "x " * 50_000), (4, "you idiot !!!")])
    for known in (labels, labels.limit(0), labels.filter("toxic = 0 and quality = 1"), labels.withColumns({"toxic": F.lit(None).cast("int"), "quality": F.lit(None).cast("int")})):
        got = module.score(texts, module.fit(docs, known)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert module.score(odd(spark, []), module.fit(docs, labels)).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    at, value = toxicity.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= -1e-12).all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = getattr(queries, name)(spark, "/root/testdata/sf0.001").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
