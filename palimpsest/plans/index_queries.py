"""Stored indexes: vectors by cell, words by block, both kept up by increments, with the same rows as full scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import ops, trees
from palimpsest.operators.containment import quoted_in
from palimpsest.operators.hashtree import DigestedTable, reconcile
from palimpsest.operators.ivf import VectorIndex
from palimpsest.operators.lexical_index import LexicalIndex
from palimpsest.operators.projection import Change, Projection
from palimpsest.operators.ranges import running
from palimpsest.operators.stored import fingerprint, new_folder, shared_dir
from palimpsest.plans.registry import query
from palimpsest.plans.search_queries import QUERY_VECTOR, _bm25_sql, _vector_sql
from palimpsest.plans.tables import chunks, memories, messages, table

#: Indexes that this process has opened, by folder.
_OPEN: dict[str, VectorIndex | LexicalIndex] = {}
PAYLOAD = ("memory_type", "status", "privacy", "scopes")


def opened(spark: SparkSession, name: str, at: Callable, fill: Callable):
    """The index of a name in the shared folder, opened once a process, and filled if nothing has been committed to it."""
    root = f"{shared_dir(spark)}/{name}"
    if root not in _OPEN:
        index = at(root)
        if index.store.manifest() is None:
            fill(index)
        _OPEN[root] = index
    return _OPEN[root]


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of embeddings, with memories' payload where a vector has one."""
    vectors = table(spark, sf_dir, "embeddings")
    mark = fingerprint(vectors)
    payload = memories(spark, sf_dir).select(F.col("memory_id").alias("vec_id"), *PAYLOAD)
    return opened(spark, f"vectors-{mark[:24]}", lambda root: VectorIndex(spark, root), lambda index: index.build(vectors.join(payload, "vec_id", "left"), mark))


def lexical_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    mark = fingerprint(table(spark, sf_dir, "documents"))
    payload = ("memory_type", "status", "privacy")
    return opened(spark, f"words-{mark[:24]}", lambda root: LexicalIndex(spark, root, payload=payload), lambda index: index.commit(memories(spark, sf_dir), mark))


def listed(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A top-k list as a table."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


@query(_vector_sql("cosine", 10))
def vector_index_proved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_index(spark, sf_dir).search(QUERY_VECTOR, 10, prove=True)
    return listed(spark, found, "vec_id long, score double").withColumn("score", F.round("score", 6))


@query(f"""
with e as (select vec_id from embeddings join memories on memory_id = vec_id where label in (1, 4, 7) and privacy = 'private' and scope <> 'a1'), s as ({_vector_sql("cosine", 1_000_000_000)}) ::
select s.vec_id, s.score from s join e using (vec_id) order by s.score desc, s.vec_id limit 12
""")
def vector_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload before the top-k: membership, equality, and scopes that are empty, open to all or the agent's."""
    scopes = F.col("scopes")
    visible = (F.size(scopes) == 0) | F.arrays_overlap(scopes, F.array(F.lit("all"), F.lit("a2")))
    allowed = F.col("label").isin(1, 4, 7) & (F.col("privacy") == "private") & visible
    found = vector_index(spark, sf_dir).search(QUERY_VECTOR, 12, allowed, prove=True)
    return listed(spark, found, "vec_id long, score double").withColumn("score", F.round("score", 6))


@query(f"with {_bm25_sql(['heed', 'tion'])} :: select chunk_id, round(bm25, 6) as bm25 from scored order by scored.bm25, chunk_id limit 20")
def lexical_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_index(spark, sf_dir).search(["heed", "tion"], 20)
    return listed(spark, found, "chunk_id long, bm25 double").withColumn("bm25", F.round("bm25", 6))


@query(f"with {_bm25_sql(['src1'])} :: select chunk_id, round(bm25, 6) as bm25 from scored where privacy = 'private' and status = 'active' order by scored.bm25, chunk_id limit 15")
def lexical_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term within words of the title; the filter is on the payload, statistics are of all chunks."""
    found = lexical_index(spark, sf_dir).search(["src1"], 15, (F.col("privacy") == "private") & (F.col("status") == "active"))
    return listed(spark, found, "chunk_id long, bm25 double").withColumn("bm25", F.round("bm25", 6))


_CHANGED = "changed as (select chunk_id, title, heading, case when chunk_id % 3 = 0 then text || ' heedless heed' else text end as text, tags from memories where chunk_id % 5 <> 1)"


@query(f"with {_CHANGED}, {_bm25_sql(['heed'])} :: select chunk_id, round(bm25, 6) as bm25 from scored order by scored.bm25, chunk_id limit 25".replace("from memories, stats", "from changed, stats").replace("as n0 from memories", "as n0 from changed"))
def lexical_index_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after an increment: a third of the chunks with new text, a fifth taken out. Counts are those of what is left."""
    rows = memories(spark, sf_dir)
    index = LexicalIndex(spark, new_folder(spark, "words"))
    index.commit(rows, "first")
    new = rows.filter("chunk_id % 3 = 0 and chunk_id % 5 <> 1").withColumn("text", F.concat("text", F.lit(" heedless heed")))
    index.commit(new, "second", removed=rows.filter("chunk_id % 5 = 1").select("chunk_id"))
    return listed(spark, index.search(["heed"], 25), "chunk_id long, bm25 double").withColumn("bm25", F.round("bm25", 6))


# references by eight ways, digests, two phases

_RECORDS = """
r as (select message_id, 'X' || conversation_id || '-' || sequence as external_id, cast(conversation_id as varchar) as conversation, 'conv:' || conversation_id as conversation_external, source_id, 'src:' || source_id as source_external,
  'raw/' || conversation_id || '/' || sequence as raw_reference, '{"mail":"M' || conversation_id || '_' || sequence || '@h","role":"' || role || '"}' as metadata from messages),
refs as (select distinct case k when 0 then message_id when 1 then external_id when 2 then conversation when 3 then conversation_external when 4 then source_external when 5 then raw_reference when 6 then 'm' || conversation || substr(raw_reference, 5 + length(conversation)) || '@H'
  when 7 then 'M' || conversation || '%@h' else 'nothing ' || message_id end as ref from (select *, (row_number() over (order by message_id) - 1) % 9 as k from r))"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("conversation_id").cast("string"), F.col("sequence").cast("string")
    joined = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    return messages(spark, sf_dir).select(
        "message_id", joined("X", c, "-", s).alias("external_id"), c.alias("conversation"), joined("conv:", c).alias("conversation_external"), "source_id", joined("src:", F.col("source_id")).alias("source_external"),
        joined("raw/", c, "/", s).alias("raw_reference"), joined('{"mail":"M', c, "_", s, '@h","role":"', F.col("role"), '"}').alias("metadata"),
    )


@query(f"""
with {_RECORDS}, hits as (select ref, r.message_id from refs join r on ref in (r.message_id, r.external_id, r.conversation, r.conversation_external, r.source_id, r.source_external, r.raw_reference) or lower(r.metadata) like lower('%"' || ref || '"%')) ::
select ref, case when n = 1 then message_id end as message_id, case when n is null then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end as outcome from refs left join (select ref, count(*) as n, min(message_id) as message_id from (select distinct * from hits) group by ref) using (ref)
""")
def ref_resolution_all_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by seven equalities and by a quoted piece of metadata with LIKE's wildcards; one that exactly one message answers
    to is resolved. Each equality is a hash join of its own; quoted pieces are joined by hash too, those with wildcards by automata."""
    r = _records(spark, sf_dir)
    c = F.col("conversation")
    mine = F.concat(F.lit("m"), c, F.substring("raw_reference", F.length(c) + 5, F.lit(1 << 20)), F.lit("@H"))
    ways = [F.col("message_id"), F.col("external_id"), c, F.col("conversation_external"), F.col("source_external"), F.col("raw_reference"), mine, F.concat(F.lit("M"), c, F.lit("%@h")), F.concat(F.lit("nothing "), "message_id")]
    turn = running(r, [F.col("message_id")], {}, "nth").withColumn("nth", F.col("nth") - 1)
    refs = turn.select(F.element_at(F.array(*ways), (F.pmod("nth", F.lit(9)) + 1).cast("int")).alias("ref")).distinct()
    keys = ["message_id", "external_id", "conversation", "conversation_external", "source_id", "source_external", "raw_reference"]
    equal = [refs.join(r.select(F.col(k).alias("ref"), F.col("message_id").alias("_m")), "ref").select("ref", F.col("_m").alias("message_id")) for k in keys]
    told = ops.unique_resolution([*equal, quoted_in(r, refs, "message_id", "metadata", "ref")], "ref", "message_id")
    return refs.join(told, "ref", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unresolved")))


@query("""
with a as (select doc_id as id, sha256(coalesce(text, '')) as h from documents), b as (select id, case when id % 499 = 7 then 'changed' else h end as h from a where id % 331 <> 5 union all select id + 1000000000, h from a where id % 499 = 3) ::
select id, case when a.id is null then 'added' when b.id is null then 'removed' else 'updated' end as change from a full join b using (id) where a.h is distinct from b.h
""")
def reconcile_by_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored copies of a table, one a few changes behind: only folders whose digests differ are read."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    behind, ahead = (DigestedTable(spark, new_folder(spark, "digests"), "id", "h", leaves=64) for _ in range(2))
    behind.commit(rows, "first")
    ahead.commit(rows, "first")
    new = rows.filter("id % 499 = 7").withColumn("h", F.lit("changed")).unionByName(rows.filter("id % 499 = 3").withColumn("id", F.col("id") + 1_000_000_000))
    ahead.commit(new.filter("id % 331 <> 5 or id >= 1000000000"), "second", removed=rows.filter("id % 331 = 5"))
    return reconcile(behind, ahead)


@query("""
with d as (select memory_id, title, length(text) as size from memories where memory_id % 4 <> 1), p as (select chunk_id, memory_id from chunks where memory_id % 4 <> 1) ::
select memory_id, case when memory_id % 4 = 2 then 'again ' || title else title end as title, count(chunk_id) as pieces from d left join p using (memory_id) group by all
""")
def two_phase_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their chunks as one projection: a change that ends between its phases leaves no trace, is repaired and made
    again; a replay writes nothing. A quarter of the documents changes, a quarter goes, with all of their chunks."""
    docs, parts = memories(spark, sf_dir).select("memory_id", "title"), chunks(spark, sf_dir).select("chunk_id", "memory_id")
    store = Projection(spark, new_folder(spark, "projection"), {"documents": "memory_id", "chunks": "memory_id"})
    store.commit({"documents": Change(docs), "chunks": Change(parts)}, "first")
    gone = docs.filter("memory_id % 4 = 1")
    new = docs.filter("memory_id % 4 = 2").withColumn("title", F.concat(F.lit("again "), "title"))
    change = {"documents": Change(new, gone), "chunks": Change(parts.filter("memory_id % 4 = 2"), gone)}
    store.prepare(change, "second")
    store.repair()
    store.commit(change, "second")
    store.commit(change, "second")
    counts = store.read("chunks").groupBy("memory_id").agg(F.count("*").alias("pieces"))
    return store.read("documents").join(counts, "memory_id", "left").fillna(0, ["pieces"])


# trees

_TREE = """
t as (select doc_id as node, case when doc_id % 97 = 0 then null when doc_id = 200 then 203 when doc_id % 5 = 0 then doc_id - 3 else doc_id - 1 end as parent from documents)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 97 with branches, one with a cycle; all in one tree table."""
    d = F.col("doc_id")
    parent = F.when(d % 97 == 0, None).when(d == 200, 203).when(d % 5 == 0, d - 3).otherwise(d - 1)
    return table(spark, sf_dir, "documents").select(F.lit("c").alias("conversation"), d.alias("node"), parent.cast("long").alias("parent"))


@query(f"""
with recursive {_TREE}, walk(node, root, depth) as (select node, node, 0::bigint from t where parent is null or parent not in (select node from t) union all select t.node, walk.root, walk.depth + 1 from walk join t on t.parent = walk.node) ::
select node, root, depth from t left join walk using (node)
""")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root and depth of every node; none for those that a cycle keeps from a root."""
    return trees.roots(_tree(spark, sf_dir), "conversation", "node", "parent").drop("conversation")


@query(f"""
with recursive {_TREE}, walk(node) as (select node from t where node % 211 = 60 or node = 230 union select t.parent from walk join t using (node) where t.parent in (select node from t)) ::
select node from walk
""")
def tree_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes on the way from chosen ones to their roots, a cycle once."""
    nodes = _tree(spark, sf_dir)
    return trees.ancestors(nodes, nodes.filter("node % 211 = 60 or node = 230"), "conversation", "node", "parent").select("node")
