"""Projections, stored indexes and digests: the same results as full scans, and what is read for them."""

from __future__ import annotations

import random
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from palimpsest.operators import containment, hashtree, ivf, lexical_index, merge, search, trees, writes
from palimpsest.operators.projection import Change, Projection
from palimpsest.operators.stored import new_folder

SF = "/root/testdata/sf0.01"


def test_lexical_commit_writes_no_text_and_counts_words_before_a_shuffle(spark, monkeypatch):
    """Postings are those of plain Python, blanks of every kind, nulls and chunks of one length among them; the columns of chunks are not
    written on the way, and rows are shuffled as chunks, not as words."""
    rng, seen, plans = random.Random(5), [], []
    blanks = [chr(c) for c in range(1, 0x3001) if chr(c).isspace()]
    text = lambda n: "".join(rng.choice(["Aa", "bb", "É", "日本", "c1"]) + rng.choice([*blanks, " ", " ", "x"]) * rng.randrange(1, 3) for _ in range(n))
    rows = [(k, "t " + text(1), None if k % 7 == 0 else "head", None if k % 9 == 0 else text(rng.randrange(12)), "") for k in range(60)] + [(k, "same", "", "one two", "x") for k in range(60, 160)]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, heading string, text string, tags string")
    write, commit = DataFrameWriter.parquet, Projection.commit
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: seen.append(self._df.columns) or write(self, *a, **k))
    monkeypatch.setattr(Projection, "commit", lambda self, changes, *a: plans.append(changes["postings"].rows._jdf.queryExecution().executedPlan().toString()) or commit(self, changes, *a))
    monkeypatch.setattr(lexical_index, "BLOCK_CHUNKS", 16)
    index = lexical_index.LexicalIndex(spark, new_folder(spark, "w"))
    index.commit(chunks, "one")
    assert not [c for c in seen if {"text", "title", "tags"} & set(c)]
    assert plans[0].count("Exchange") == 1 and plans[0].index("MapInArrow") < plans[0].index("Exchange")
    want = Counter()
    for k, *columns in rows:
        for value, weight in zip(columns, search.WEIGHTS.values(), strict=True):
            for w in (value or "").lower().split():
                want[k, w] += weight
    held = index.store.read("postings").collect()
    assert {(r.chunk_id, r.word): r.tf for r in held} == want and len(held) == len(want)
    blocks = {r.chunk_id: r.block for r in index.store.read("docs").collect()}
    assert all(blocks[r.chunk_id] == r.block for r in held) and len(blocks) == 160 and len({blocks[k] for k in range(60, 160)}) > 2
    index.commit(chunks.filter("chunk_id % 3 = 0").withColumn("text", F.lit("new")), "two", removed=chunks.filter("chunk_id % 5 = 1").select("chunk_id"))
    left = {k: v for k, v in want.items() if k[0] % 3 and k[0] % 5 != 1}
    assert {k: v for k, v in {(r.chunk_id, r.word): r.tf for r in index.store.read("postings").collect()}.items() if k[0] % 3} == left
    counts = {r.word: r.n for r in index.store.read("headers").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert counts["new"] == len(range(0, 160, 3)) and counts["same"] == sum(k % 3 == 0 or k % 5 != 1 for k in range(60, 160))


# two-phase projections


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v string")


def state(p, name="a"):
    return sorted((r.id, r.v) for r in p.read(name).collect())


def test_projection_phases(spark):
    p = Projection(spark, new_folder(spark, "p"), {"a": "id", "b": "id"})
    with pytest.raises(ValueError, match="no committed state"):
        p.read("a")
    assert p.commit({"a": Change(table(spark, [(1, "x"), (2, "y")])), "b": Change(table(spark, [(1, "n")]))}, "one")
    assert not p.commit({"a": Change(table(spark, [(9, "z")]))}, "one")  # a replay writes nothing
    assert state(p) == [(1, "x"), (2, "y")]

    change = {"a": Change(table(spark, [(2, "w"), (3, "q")]), table(spark, [(1, "")])), "b": Change(table(spark, [(4, "m")]), replaces=False)}
    p.prepare(change, "two")  # killed between the phases
    again = Projection(spark, p.root, p.keys)
    assert state(again) == [(1, "x"), (2, "y")] and state(again, "b") == [(1, "n")]
    assert len(again.repair()) == 1 and again.repair() == []
    assert again.commit(change, "two") and state(again) == [(2, "w"), (3, "q")] and state(again, "b") == [(1, "n"), (4, "m")]


def test_projection_leaves_no_shuffle_files(spark):
    """What a commit has shuffled goes when its tables are written, while the plan is still held; other queries keep their setting."""
    folders = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*") if f.stat().st_size}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, mode = files(), spark.conf.get(name)
    p = Projection(spark, new_folder(spark, "p"), {"a": "id", "b": "id"})
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("v")).repartition(6, "id")
    for k in "xy":
        p.commit({"a": Change(rows), "b": Change(rows.groupBy("id").count())}, k)
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(name) == mode
    assert rows.count() == 5000 == p.read("a").count()


def test_projection_two_writers(spark):
    p = Projection(spark, new_folder(spark, "p"), {"a": "id"})
    p.commit({"a": Change(table(spark, [(1, "x")]))}, "one")
    first, second = (p.prepare({"a": Change(table(spark, [(1, v)]))}, v) for v in "ab")
    assert p.activate(first) and not p.activate(second) and state(p) == [(1, "a")]


def test_projection_compact_and_forget(spark):
    p, rng, want = Projection(spark, new_folder(spark, "p"), {"a": "id"}), random.Random(1), {}
    for k in range(6):
        new, gone = {rng.randrange(12): f"{k}" for _ in range(4)}, [rng.randrange(12)] if k else []
        p.commit({"a": Change(table(spark, list(new.items())), table(spark, [(g, "") for g in gone]))}, str(k))
        want = {i: v for i, v in want.items() if i not in gone} | new
    assert state(p) == sorted(want.items())
    assert p.compact("a", most=3) and not p.compact("a", most=3) and state(p) == sorted(want.items())
    assert p.forget(keep=1) and len(p._names("manifests")) == 1 and state(p) == sorted(want.items())
    p.commit({"a": Change(table(spark, []), table(spark, [(i, "") for i in want]))}, "none")
    assert state(p) == []


# vectors by cell


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def exact(vectors, query, k, allowed=None):
    rows = vectors.filter(allowed) if allowed is not None else vectors
    return [(r.vec_id, pytest.approx(r.score, abs=1e-12)) for r in search.vector_topk(rows, query, k).collect()]


def test_vector_index_recall_and_proof(spark, vectors):
    index = ivf.VectorIndex(spark, new_folder(spark, "v"))
    assert index.build(vectors, "m") and not index.build(vectors, "m")
    queries = [r.embedding for r in vectors.filter("vec_id % 100 = 0").orderBy("vec_id").collect()]
    hits = 0
    for q in queries:
        want = exact(vectors, q, 10)
        proved = index.search(q, 10, prove=True)
        assert [(r.vec_id, r.score) for r in proved] == want
        hits += len({i for i, _ in want} & {r.vec_id for r in index.search(q, 10)})
    assert hits / (10 * len(queries)) >= 0.95
    far = [1.0] + [0.0] * 63
    assert [(r.vec_id, r.score) for r in index.search(far, 7, F.col("label") == 3, prove=True)] == exact(vectors, far, 7, F.col("label") == 3)
    assert len(index.search(far, 10_000)) == 500 and index.search([1.0], 3) == [] and len(index.search([0.0] * 64, 3, prove=True)) == 3


def test_vector_index_reads_probed_cells_only(spark, vectors):
    index = ivf.VectorIndex(spark, new_folder(spark, "v"))
    index.build(vectors, "m")
    index.search([1.0] * 64, 5, most=2)
    plan = index.store.read("vectors").filter(F.col("cell").isin(index.probed))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and len(index.probed) == 2


def test_vector_index_clustered(spark):
    """Where vectors cluster, both searches read few cells."""
    rng = random.Random(2)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in middles[i % 20]]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = ivf.VectorIndex(spark, new_folder(spark, "v"))
    index.build(df, "m")
    for prove in (False, True):
        assert [(r.vec_id, r.score) for r in index.search(rows[7][1], 10, prove=prove)] == exact(df, rows[7][1], 10)
        assert len(index.probed) <= 8


def test_vector_index_increment(spark, vectors):
    index = ivf.VectorIndex(spark, new_folder(spark, "v"))
    index.build(vectors.filter("vec_id < 300"), "m")
    new = vectors.filter("vec_id >= 250").withColumn("embedding", F.transform("embedding", lambda x: (x * F.lit(-2)).cast("float")))
    index.add(new, "n", removed=vectors.filter("vec_id % 7 = 0"))
    now = vectors.filter("vec_id < 250 and vec_id % 7 <> 0").unionByName(new)
    q = vectors.filter("vec_id = 260").first().embedding
    assert [(r.vec_id, r.score) for r in index.search(q, 15, prove=True)] == exact(now, q, 15)


def test_vector_index_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [-1.0, 0.0])]
    index = ivf.VectorIndex(spark, new_folder(spark, "v"))
    index.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "m")
    assert [(r.vec_id, r.score) for r in index.search([2.0, 0.0], 9, prove=True)] == [(2, 1.0), (3, 1.0), (1, 0.0), (6, -1.0)]
    none = ivf.VectorIndex(spark, new_folder(spark, "v"))
    none.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), "m")
    assert none.search([1.0, 2.0], 3) == []


# words by block


def chunks(spark, rows):
    return spark.createDataFrame([(i, t, None, x, g, "p" if i % 2 else "q") for i, t, x, g in rows], "chunk_id long, title string, heading string, text string, tags string, privacy string")


def scanned(df, terms, limit, allowed=None):
    return [(r.chunk_id, pytest.approx(r.bm25, rel=1e-12)) for r in search.lexical(df, terms, allowed, limit=limit).collect()]


def words(n, rng):
    pool = ["banana", "bandana", "an", "ban", "Bänder", "BANAL", "cab", "ana", "anana", "x"]
    return " ".join(rng.choice(pool) for _ in range(n))


def test_lexical_index_equals_scan(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_CHUNKS", 16)
    rng = random.Random(3)
    df = chunks(spark, [(i, words(rng.randrange(3), rng), words(rng.randrange(1, 60), rng), None if i % 3 else words(2, rng)) for i in range(300)])
    index = lexical_index.LexicalIndex(spark, new_folder(spark, "w"), payload=("privacy",))
    assert index.commit(df, "m") and not index.commit(df, "m")
    for terms in (["ana"], ["ban", "ana"], ["bandana"], ["BÄN"], ["banana", "cab"], ["zzz"], ["ban", "zzz"]):
        assert [(r.chunk_id, r.bm25) for r in index.search(terms, 12)] == scanned(df, terms, 12), terms
    private = F.col("privacy") == "p"
    assert [(r.chunk_id, r.bm25) for r in index.search(["ana"], 9, private)] == scanned(df, ["ana"], 9, private)
    assert index.search(["an"], 3) == [] == index.search([], 3) == index.search(["an b"], 3)

    changed = chunks(spark, [(i, "t", words(rng.randrange(1, 30), rng), None) for i in range(250, 340)])
    gone = df.filter("chunk_id % 4 = 0").select("chunk_id")
    index.commit(changed, "n", removed=gone)
    now = df.filter("chunk_id % 4 <> 0 and chunk_id < 250").unionByName(changed)
    for terms in (["ana"], ["ban", "ana"], ["banal"]):
        assert [(r.chunk_id, r.bm25) for r in index.search(terms, 12)] == scanned(now, terms, 12), terms


def test_lexical_index_leaves_blocks_out(spark, monkeypatch):
    """Blocks that cannot reach the k-th score are not scored."""
    monkeypatch.setattr(lexical_index, "BLOCK_CHUNKS", 16)
    monkeypatch.setattr(lexical_index, "FIRST_BLOCKS", 2)
    df = chunks(spark, [(i, None, "needle " * (5 if i < 20 else 1) + "hay " * i, None) for i in range(400)])
    index = lexical_index.LexicalIndex(spark, new_folder(spark, "w"))
    index.commit(df, "m")
    held = index.store.read("docs").select("block").distinct().count()
    assert [(r.chunk_id, r.bm25) for r in index.search(["needle"], 5)] == scanned(df, ["needle"], 5)
    plans = []
    monkeypatch.setattr(index, "_score", lambda postings, *rest: plans.append(postings.select("block").distinct().count()) or lexical_index.LexicalIndex._score(index, postings, *rest))
    index.search(["needle"], 5)
    assert sum(plans) <= 4 < held


# digests


def test_reconcile_reads_what_differs(spark):
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    before, after = (hashtree.DigestedTable(spark, new_folder(spark, "h"), "id", "h") for _ in range(2))
    before.commit(rows, "m")
    after.commit(rows, "m")
    assert hashtree.differing(before, after) == [] and hashtree.reconcile(before, after).count() == 0
    new = spark.createDataFrame([(5, "new"), (77, "new"), (9001, "new"), (9002, "new")], "id long, h string")
    after.commit(new, "n", removed=spark.createDataFrame([(10,), (11,), (77_000,)], "id long"))  # counts stay equal
    leaves = hashtree.differing(before, after)
    assert 1 <= len(leaves) <= 6
    got = sorted((r.id, r.change) for r in hashtree.reconcile(before, after).collect())
    assert got == [(5, "updated"), (10, "removed"), (11, "removed"), (77, "updated"), (9001, "added"), (9002, "added")]
    full = merge.diff(before.store.read("rows"), after.store.read("rows"), "id", "h").filter("change <> 'unchanged'")
    assert sorted((r.id, r.change) for r in full.collect()) == got
    plan = before.rows(leaves)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [leaf" in plan
    before.commit(new, "n", removed=spark.createDataFrame([(10,), (11,)], "id long"))
    assert hashtree.differing(before, after) == []


# trees


def test_tree_of_many_nodes(spark):
    """One conversation of 100,000 nodes: a long chain, a star, branches, a missing parent and a cycle that nodes lead to."""
    parent = {i: i - 1 for i in range(1, 5000)} | {i: 7 for i in range(5000, 60_000)} | {i: i // 2 + 30_000 for i in range(60_001, 99_000)} | {60_000: 7} | {99_000: 99_002, 99_001: 99_000, 99_002: 99_001}
    parent |= {i: i - 1 for i in range(99_003, 99_500)} | {99_500: 123_456_789, 99_501: 99_501} | {i: None for i in range(99_502, 100_000)} | {0: None}
    depth: dict = {}
    for i in parent:
        way, at = [], i
        while at is not None and at in parent and at not in depth and len(way) < 10_000 and at not in way[-4:]:
            way.append(at)
            at = parent[at]
        if at is None or at not in parent:
            depth[way[-1]] = (way[-1], 0)
        elif at not in depth:
            depth |= {w: (None, None) for w in way}
        for w in reversed(way):
            if w not in depth:
                r, d = depth[parent[w]]
                depth[w] = (r, None if d is None else d + 1)
    df = spark.createDataFrame([("c", i, p) for i, p in parent.items()], "t string, n long, p long")
    got = {r.n: (r.root, r.depth) for r in trees.roots(df, "t", "n", "p").collect()}
    assert got == depth and got[4999] == (0, 4999) and got[99_400] == (None, None) == got[99_501]
    up = {r.n for r in trees.ancestors(df, df.filter("n in (70000, 99100, 99600)"), "t", "n", "p").collect()}
    want, at = {99_600, *range(99_000, 99_101)}, 70_000
    while at is not None:
        want.add(at)
        at = parent[at]
    assert up == want


# patterns


def test_containing(spark):
    texts = [(1, "abcabc"), (2, "xaby"), (3, None), (4, ""), (5, "Ünïcödé ab")]
    items = [(1, "abc"), (2, "ab"), (3, ""), (4, None), (5, "nïc"), (6, "ab"), (7, "zz")]
    df, patterns = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(items, "item int, p string")
    want = sorted((i, d) for i, p in items for d, t in texts if p is not None and t is not None and p in t)
    for block in (1 << 20, 3):
        assert sorted(map(tuple, containment.containing(df, patterns, "id", "t", "item", "p", block).collect())) == want


def test_quoted_like(spark):
    texts = [(1, '{"a":"M1_x"}'), (2, '{"A":"m1Zx","b":""}'), (3, '"a.b" c "d"'), (4, None), (5, 'say "it" and " c "')]
    refs = ["M1_x", "m1zx", "M1%", "", "a.b", "a_b", ' c ', "%", 'd"', "é", "a"]
    df, r = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(x,) for x in refs], "ref string")
    import duckdb

    con = duckdb.connect()
    con.sql("create table t as select * from (values " + ", ".join(f"({i}, {'null' if t is None else chr(39) + t + chr(39)})" for i, t in texts) + ") v(id, t)")
    con.sql("create table r as select * from (values " + ", ".join(f"('{x}')" for x in refs) + ") v(ref)")
    want = sorted(con.sql("select ref, id from t join r on lower(t) like lower('%\"' || ref || '\"%')").fetchall())
    assert sorted(map(tuple, containment.quoted_in(df, r, "id", "t", "ref").collect())) == want and len(want) > 10


# states after repeated keys


def test_repeated_new_keys(spark):
    own = "k string, version int, authority int, since int, state string, until int"
    old = spark.createDataFrame([("a", 1, 5, 0, "active", None), ("b", 2, 9, 0, "active", None)], own)
    new = spark.createDataFrame([("a", 3, 6, 10, "active", None), ("a", 4, 5, 20, "active", None), ("a", 5, 6, 30, "active", None), ("b", 6, 1, 5, "active", None), ("c", 7, 1, 5, "active", None)], own)
    got = sorted((r.k, r.version, r.state, r.until) for r in writes.supersede(old, new, "k").collect())
    assert got == [("a", 1, "superseded", 10), ("a", 3, "superseded", 30), ("a", 5, "active", None), ("b", 2, "active", None), ("c", 7, "active", None)]
    before, rows = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (1, "z"), (2, "w")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(before, rows, ["k"]).collect())) == [(1, "z"), (2, "w")]
