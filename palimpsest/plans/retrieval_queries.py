"""The whole search call, its fallback and explanation, and context packs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import values
from palimpsest.operators import retrieval, search
from palimpsest.operators.ivf import VectorIndex
from palimpsest.operators.lexical_index import LexicalIndex
from palimpsest.operators.stored import fingerprint
from palimpsest.plans.index_queries import opened
from palimpsest.plans.registry import query
from palimpsest.plans.search_queries import _BOOST, AS_OF, QUERY_VECTOR, _bm25_sql, _reason_sql, _vector_sql
from palimpsest.plans.tables import chunks, memories, messages, spread, table

FILTERS = retrieval.Filters(privacy=("private",), agent="a2", instant=AS_OF)
_PRIVATE = "privacy = 'private'"
_STORED = "privacy = 'private' and status in ('active', 'needs_review', 'received')"


def _memories(spark: SparkSession, sf_dir: str) -> retrieval.Archive:
    """Memories of one chunk each; normal ones stand for evidence."""
    return retrieval.scanned(spread(memories(spark, sf_dir)), table(spark, sf_dir, "embeddings"), evidence=F.col("tier") == "normal")


def _find_sql(lexical: str, terms: list[str], limit: int, stored: str = _STORED) -> str:
    """Tables that end in `found` (with place): both channels, fused, filtered and settled."""
    n = max(6 * limit, 30)
    boost = _BOOST.replace("'src1'", f"'{terms[0]}'").replace("'en'", f"'{terms[-1]}'")
    return f"""
{lexical}, ok as (select memory_id from ({_reason_sql('current')}) where reason = 'currently_valid'),
near as (select vec_id as chunk_id, score, row_number() over (order by score desc, vec_id) as rank from ({_vector_sql('cosine', n)}) where score >= 0),
fused as (select chunk_id, sum(1.0::double / (60 + rank)) as rrf, case when bool_and(score is not null) then least(1.0, max(score)) end as alone from (select chunk_id, rank, null as score from lex union all select chunk_id, rank, score from near) group by chunk_id),
told as (select m.*, alone, round(rrf + {boost}, 8) as retrieval_score from fused join memories m using (chunk_id) join ok using (memory_id) where {stored} and scope <> 'a1'),
top as (select *, max(authority) over (partition by project, memory_type, conflict_key) as most, case when tier = 'normal' then 'evidence' else 'memory' end as channel from told),
found as (select *, row_number() over (order by channel desc, retrieval_score desc, importance desc, chunk_id) as place from top where conflict_key = '' or authority >= most
  order by channel desc, retrieval_score desc, importance desc, chunk_id limit {limit})"""


def _best_lexical(terms: list[str], limit: int, stored: str = _STORED) -> str:
    return f"""{_bm25_sql(terms)}, best as (select chunk_id, bm25 from scored where {stored} order by scored.bm25, chunk_id limit {max(6 * limit, 30)}),
lex as (select chunk_id, row_number() over (order by bm25, chunk_id) as rank from best where chunk_id in (select memory_id from ({_reason_sql('current')}) where reason = 'currently_valid'))"""


@query(f"""
with {_find_sql(_best_lexical(['heed', 'tion'], 10), ['heed', 'tion'], 10)} :: select chunk_id, retrieval_score, channel, cast(place as int) as place
  from found
""")
def search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.find(_memories(spark, sf_dir), '"heed"  tion', QUERY_VECTOR, 10, FILTERS)
    return found.rows.select("chunk_id", "retrieval_score", "channel", "place")


_ANY = "(contains(lower(title), '{p}') or contains(lower(heading), '{p}') or contains(lower(text), '{p}') or contains(lower(tags), '{p}'))"
_NARROW = _STORED + " and memory_type = 'decision'"
_SHORT = f"""{_best_lexical(['src1'], 40, _NARROW).replace('lex as', 'lex0 as')},
lex as (select chunk_id, row_number() over (order by late, by_, chunk_id) as rank from (select chunk_id, late, by_ from (
  select chunk_id, 0 as late, bm25 as by_ from best where chunk_id in (select chunk_id from lex0)
  union all select chunk_id, 1, 0 from memories where {_NARROW} and contains(lower(title || ' ' || heading || ' ' || text || ' ' || tags), 'src1') and contains(lower(title || ' ' || heading || ' ' || text || ' ' || tags), 'de')
    and chunk_id not in (select chunk_id from lex0) and chunk_id in (select memory_id from ({_reason_sql('current')}) where reason = 'currently_valid')) order by late, by_, chunk_id limit 240))"""


@query(f"""
with {_find_sql(_SHORT, ['src1', 'de'], 40, _NARROW)},
sub as (select * from memories where {_NARROW} and {_ANY.format(p='src1')} and {_ANY.format(p='de')} order by contains(lower(title), 'src1') desc, weight desc, chunk_id limit 120),
late as (select chunk_id, contains(lower(title), 'src1')::int as hit, weight from sub where scope <> 'a1' and chunk_id not in (select chunk_id from found) and memory_id in (select memory_id from ok)),
again as (select chunk_id, row_number() over (order by l, a, b, chunk_id) as rank from (select chunk_id, 0 as l, place as a, 0.0 as b from found union all select chunk_id, 1, -hit, -weight from late)),
scored2 as (select m.*, round(1.0::double / (60 + rank) + {_BOOST.replace("'en'", "'de'")} + coalesce((select alone from found where found.chunk_id = m.chunk_id), 0) * 0.01::double, 8) as retrieval_score from again join memories m using (chunk_id)),
top2 as (select *, max(authority) over (partition by project, memory_type, conflict_key) as most, case when tier = 'normal' then 'evidence' else 'memory' end as channel from scored2),
second as (select *, row_number() over (order by channel desc, retrieval_score desc, importance desc, chunk_id) as place from top2 where conflict_key = '' or authority >= most
  order by channel desc, retrieval_score desc, importance desc, chunk_id limit 40)
:: select chunk_id, retrieval_score, cast(place as int) as place from found where (select count(*) from found) >= 40 union all select chunk_id, retrieval_score, cast(place as int) from second where (select count(*) from found) < 40
""")
def search_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with a term too short for trigrams, and fewer hits than wanted: both fallbacks, and a second fusion."""
    found = retrieval.find_enhanced(_memories(spark, sf_dir), "src1 de", QUERY_VECTOR, 40, replace(FILTERS, types=("decision",)))
    return found.rows.select("chunk_id", "retrieval_score", "place")


def _past_sql(terms: list[list[str]], limit: int, rows: str = "memories", shown: int = 10) -> str:
    """Tables that end in `excluded`: for each row of found what searches in history find, `terms` of each search, and by meaning."""
    n = max(12 * shown, 60)
    key = "chunk_id"
    lists = ", ".join(
        f"{_bm25_sql(t).replace('stats', f'stats_{i}').replace('scored', f'scored_{i}').replace('from memories', f'from {rows}')}, past_{i} as (select chunk_id, {i} as q, row_number() over (order by bm25, chunk_id) as r "
        f"from (select chunk_id, bm25 from scored_{i} where privacy = 'private' order by bm25, chunk_id limit {n}))" for i, t in enumerate(terms)
    )
    some = " union all ".join(f"select * from past_{i}" for i in range(len(terms)))
    vector = f"select {'vec_id' if rows == 'memories' else 'vec_id * 100000'} as chunk_id, {len(terms)} as q, row_number() over (order by score desc, vec_id) as r from ({_vector_sql('cosine', n)}) where score >= 0"
    reasons = lambda mode: _reason_sql(mode).replace("select memory_id", f"select {key}").replace("from memories", f"from {rows}")
    return f"""
{lists}, listed as (select c.memory_id, l.* from ({some} union all {vector}) l join {rows} c using (chunk_id) where chunk_id in (select chunk_id from ({reasons('history')}) where reason = 'history_requested')),
firsts as (select memory_id, arg_min(chunk_id, q * 1000000 + r) as chunk_id, min(q * 1000000 + r) as place from listed group by memory_id),
beaten as (select distinct memory_id from top where conflict_key <> '' and authority < most and (project, memory_type, conflict_key) in (select (project, memory_type, conflict_key) from found)),
past as (select m.*, f.place, case when memory_id in (select memory_id from beaten) then 'lower_authority_conflict' else r.reason end as reason from firsts f join {rows} m using (chunk_id, memory_id) join ({reasons('current')}) r using (chunk_id)
  where m.privacy = 'private' and m.scope <> 'a1' and memory_id not in (select memory_id from found)),
out_ as (select * from past where reason <> 'currently_valid' order by place limit 50),
lists as (select project, memory_type, privacy, conflict_key, '[' || string_agg('{{"id":' || chunk_id || ',"reason":"' || reason || '"}}', ',' order by chunk_id) || ']' as excluded from out_ group by all)"""


@query(f"""
with {_find_sql(_best_lexical(['heed', 'tion'], 10), ['heed', 'tion'], 10)}, {_past_sql([['heed', 'tion'], ['heed'], ['tion']], 50)}
:: select f.chunk_id, coalesce(l.excluded, '[]') as excluded from found f left join lists l on l.project = f.project and l.memory_type = f.memory_type and l.privacy = f.privacy and l.conflict_key = f.conflict_key
""")
def search_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches in history find and the current view leaves out, with the reason."""
    a = _memories(spark, sf_dir)
    return retrieval.explained(a, retrieval.find(a, "heed tion", QUERY_VECTOR, 10, FILTERS), "heed tion", QUERY_VECTOR, FILTERS)


# the same on memories of several chunks, with derived rows and evidence


def _pieces(spark: SparkSession, sf_dir: str) -> retrieval.Archive:
    vectors = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id") * 100_000)
    return retrieval.scanned(spread(chunks(spark, sf_dir)), vectors)


def _chunk_sql(mode: str, lexical: str, terms: list[str], limit: int, stored: str, wanted: str = "true", reward: str = "0") -> str:
    """As _find_sql, on chunks: at most three of a memory, derived rows that are not active out of current views, and lower
    authorities hidden in current views only."""
    n = max(6 * limit, 30)
    good = {"current": "currently_valid", "history": "history_requested"}[mode]
    boost = _BOOST.replace("'src1'", f"'{terms[0]}'").replace("'en'", f"'{terms[-1]}'")
    keep = "conflict_key = '' or authority >= most" if mode == "current" else "true"
    boost = f"{boost} + {reward}"
    derived = "where not (tier = 'derived' and status <> 'active')" if mode == "current" else ""
    reasons = _reason_sql(mode).replace("select memory_id", "select chunk_id, tier, status").replace("from memories", "from chunks")
    order = "retrieval_score desc, importance desc, updated desc, chunk_id"
    return f"""
ok as (select chunk_id from ({reasons}) where reason = '{good}'), lex_ok as (select chunk_id from chunks join ok using (chunk_id) {derived}),
{lexical},
near as (select vec_id * 100000 as chunk_id, score, row_number() over (order by score desc, vec_id) as rank from ({_vector_sql('cosine', n)}) where score >= 0),
fused as (select chunk_id, sum(1.0::double / (60 + rank)) as rrf, case when bool_and(score is not null) then least(1.0, max(score)) end as alone from (select chunk_id, rank, null as score from lex union all select chunk_id, rank, score from near) group by chunk_id),
told as (select m.*, alone, round(rrf + {boost}, 8) as retrieval_score from fused join chunks m using (chunk_id) join ok using (chunk_id) where {stored} and {wanted} and scope <> 'a1'),
capped as (select *, case when memory_type = 'structured_evidence' then 'evidence' else 'memory' end as channel from (select *, row_number() over (partition by memory_id order by {order}) as nth from told) where nth <= 3),
top as (select *, max(authority) over (partition by project, memory_type, conflict_key) as most from capped),
found as (select *, row_number() over (order by channel desc, {order}) as place from top where {keep} order by channel desc, {order} limit {limit})"""


def _lex_sql(terms: list[str], limit: int, stored: str) -> str:
    scored = _bm25_sql(terms).replace("from memories", "from chunks")
    return f"{scored}, best as (select chunk_id, bm25 from scored where {stored} order by scored.bm25, chunk_id limit {max(6 * limit, 30)}), lex as (select chunk_id, row_number() over (order by bm25, chunk_id) as rank from best where chunk_id in (select chunk_id from lex_ok))"


_FOUND = "select chunk_id, retrieval_score, channel, cast(place as int) as place from found"


@query(f"with {_chunk_sql('current', _lex_sql(['heed', 'tion'], 25, _STORED), ['heed', 'tion'], 25, _STORED)} :: {_FOUND}")
def search_chunks_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.find(_pieces(spark, sf_dir), "heed tion", QUERY_VECTOR, 25, FILTERS).rows.select("chunk_id", "retrieval_score", "channel", "place")


@query(f"with {_chunk_sql('current', _lex_sql(['heed', 'tion'], 25, _STORED), ['heed', 'tion'], 25, _STORED)} :: {_FOUND}")
def search_chunks_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored indexes: words by block, vectors by cell, chunks by key."""
    vectors, rows = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id") * 100_000), chunks(spark, sf_dir)
    mark = fingerprint(table(spark, sf_dir, "documents"))
    words = opened(spark, f"pieces-{mark[:24]}", lambda at: LexicalIndex(spark, at, payload=("memory_type", "status", "privacy")), lambda index: index.commit(rows, mark))
    cells = opened(spark, f"piece-vectors-{mark[:24]}", lambda at: VectorIndex(spark, at), lambda index: index.build(vectors, mark))
    found = retrieval.find(retrieval.indexed(rows, words, cells, prove=True), "heed tion", QUERY_VECTOR, 25, FILTERS)
    return found.rows.select("chunk_id", "retrieval_score", "channel", "place")


@query(f"with {_chunk_sql('history', _lex_sql(['heed', 'tion'], 25, _PRIVATE), ['heed', 'tion'], 25, _PRIVATE)} :: {_FOUND}")
def search_chunks_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superseded, archived and derived rows too, and no authority hides another."""
    found = retrieval.find(_pieces(spark, sf_dir), "heed tion", QUERY_VECTOR, 25, replace(FILTERS, mode="history"))
    return found.rows.select("chunk_id", "retrieval_score", "channel", "place")


_WHOLE = "lower(title || ' ' || heading || ' ' || text || ' ' || tags)"
_FEW = _STORED + " and memory_type = 'decision'"
_SHORT_CHUNKS = f"""{_lex_sql(['src1'], 60, _FEW).replace('lex as', 'lex0 as')},
late as (select memory_id, min(chunk_id) as chunk_id from chunks join lex_ok using (chunk_id) where {_FEW} and contains({_WHOLE}, 'src1') and contains({_WHOLE}, 'de') and memory_id not in (select memory_id from lex0 join chunks using (chunk_id)) group by memory_id order by 2 limit greatest(1, 360 - (select count(*) from lex0))),
lex as (select chunk_id, row_number() over (order by l, r, chunk_id) as rank from (select chunk_id, 0 as l, rank as r from lex0 union all select chunk_id, 1, 0 from late))"""
_AGAIN = f"""
sub as (select * from chunks where {_FEW} and {_ANY.format(p='src1')} and {_ANY.format(p='de')} order by contains(lower(title), 'src1') desc, weight desc, updated desc, chunk_id limit 180),
behind as (select chunk_id, row_number() over (order by contains(lower(title), 'src1') desc, weight desc, updated desc, chunk_id) as r from sub where scope <> 'a1' and project = 'p5' and chunk_id in (select chunk_id from ok) and chunk_id not in (select chunk_id from found)),
again as (select chunk_id, row_number() over (order by l, r) as rank from (select chunk_id, 0 as l, place as r from found union all select chunk_id, 1, r from behind)),
told2 as (select m.*, round(1.0::double / (60 + rank) + {_BOOST.replace("'en'", "'de'")} + 0.025::double + coalesce((select alone from found where found.chunk_id = m.chunk_id), 0) * 0.01::double, 8) as retrieval_score from again join chunks m using (chunk_id)),
capped2 as (select *, case when memory_type = 'structured_evidence' then 'evidence' else 'memory' end as channel from (select *, row_number() over (partition by memory_id order by retrieval_score desc, importance desc, updated desc, chunk_id) as nth from told2) where nth <= 3),
second as (select *, row_number() over (order by channel desc, retrieval_score desc, importance desc, updated desc, chunk_id) as place from (select *, max(authority) over (partition by project, memory_type, conflict_key) as most from capped2) where conflict_key = '' or authority >= most
  order by channel desc, retrieval_score desc, importance desc, updated desc, chunk_id limit 60)"""


@query(f"""
with {_chunk_sql('current', _SHORT_CHUNKS, ['src1', 'de'], 60, _FEW, "project = 'p5'", '0.025::double')}, {_AGAIN}
:: select chunk_id, retrieval_score, cast(place as int) as place from found where (select count(*) from found) >= 60 union all select chunk_id, retrieval_score, cast(place as int) from second where (select count(*) from found) < 60
""")
def search_chunks_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term too short for trigrams: one chunk of each further memory; then chunks by title, weight and time, and a second fusion."""
    found = retrieval.find_enhanced(_pieces(spark, sf_dir), "src1 de", QUERY_VECTOR, 60, replace(FILTERS, types=("decision",), project="p5"))
    return found.rows.select("chunk_id", "retrieval_score", "place")


@query(f"""
with {_chunk_sql('current', _lex_sql(['heed', 'tion'], 25, _STORED), ['heed', 'tion'], 25, _STORED)}, {_past_sql([['heed', 'tion'], ['heed'], ['tion']], 50, 'chunks', 25)}
:: select f.chunk_id, coalesce(l.excluded, '[]') as excluded from found f left join lists l on l.project = f.project and l.memory_type = f.memory_type and l.privacy = f.privacy and l.conflict_key = f.conflict_key
""")
def search_chunks_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, f = _pieces(spark, sf_dir), replace(FILTERS, mode="why")
    return retrieval.explained(a, retrieval.find(a, "heed tion", QUERY_VECTOR, 25, f), "heed tion", QUERY_VECTOR, f)


@query("""
with t as (select chunk_id, heading, memory_id, title, case when project <> 'p1' then project end as source_id from memories where contains(lower(text), 'heed')) ::
select chunk_id, '{"memory_id":' || memory_id || ',"heading":"' || heading || '","title":"' || title || '"' || case when source_id is not null then ',"source_id":"' || source_id || '"' else '' end || '}' as citation from t
""")
def search_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with the provenance that a row has; keys without a value are left out."""
    rows = memories(spark, sf_dir).filter(F.contains(F.lower("text"), F.lit("heed"))).withColumn("source_id", F.when(F.col("project") != "p1", F.col("project")))
    return rows.select("chunk_id", retrieval.citation(["title", "source_id"]).alias("citation"))


@query("""
with e as (select vec_id, case vec_id % 5 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then null when 3 then label * 0.4 - 1.0 else label * 0.4::double end as score from embeddings) ::
select vec_id, greatest(0.0, least(1.0, score)) as score from e where score is not null and not isnan(score) and not isinf(score) and score >= -0.5
""")
def semantic_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("vec_id") % 5, F.col("label") * 0.4
    score = F.when(i == 0, float("nan")).when(i == 1, float("inf")).when(i == 3, v - 1.0).when(i == 4, v)
    return retrieval.cleaned(table(spark, sf_dir, "embeddings").select("vec_id", score.alias("score")), -0.5)


@query("""
with e as (select vec_id, label, embedding from embeddings where label % 2 = 1), """ + "s as (" + _vector_sql("cosine", 1_000_000_000) + """) :: select s.vec_id, s.score from s join e using (vec_id) order by s.score desc, s.vec_id limit 15
""")
def vector_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload filter comes before the top-k."""
    e = table(spark, sf_dir, "embeddings").filter("label % 2 = 1")
    return search.vector_topk(e, QUERY_VECTOR, 15).select("vec_id", F.round("score", 6).alias("score"))


@query("""
with t as (select chunk_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from memories where contains(lower(text), 'heed') and text = trim(regexp_replace(text, '\\s+', ' ', 'g'))),
p as (select *, list_position(list_transform(w, lambda x: contains(lower(x), 'heed')), true) as first from t), b as (select *, greatest(1, first - 11) as begin from p) ::
select chunk_id, case when begin > 1 then '…' else '' end || regexp_replace(array_to_string(w[begin:begin + 21], ' '), '(?i)(heed)', '[\\1]', 'g') || case when begin + 22 <= len(w) then '…' else '' end as snippet from b
""")
def marked_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words around the first hit, hits in brackets, of texts of one line."""
    rows = memories(spark, sf_dir).filter(F.contains(F.lower("text"), F.lit("heed")) & (F.col("text") == F.trim(F.regexp_replace("text", r"\s+", " "))))
    return rows.select("chunk_id", retrieval.marked_snippet(F.col("text"), ["heed"]).alias("snippet"))


# packs


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a pack: the first core memories, then what a search found, each with evidence linked to it."""
    core = memories(spark, sf_dir).filter("tier = 'core'").orderBy(F.desc("weight"), F.desc("importance"), "memory_id").limit(40)
    found = retrieval.find(_memories(spark, sf_dir), "heed tion", QUERY_VECTOR, 40, FILTERS).rows
    rows = core.select(F.lit(0).alias("rank"), "memory_id", F.lit("").alias("message_id"), "text").unionByName(found.join(core.select("memory_id"), "memory_id", "left_anti").select(F.lit(2).alias("rank"), "memory_id", F.lit("").alias("message_id"), "text"))
    linked = rows.join(messages(spark, sf_dir).filter("sequence < 2"), F.col("memory_id") % 100 == F.col("conversation_id"))
    message = F.concat("conversation_id", F.lit(":"), "sequence")
    evidence = linked.select(F.lit(3).alias("rank"), "memory_id", message.alias("message_id"), F.col("content").alias("text"))
    return rows.unionByName(evidence)


@query()
def context_pack_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack in order of kind and ids, not of score: sections that fit, and the last ones cut at a sentence or line.

    Each section costs eighty characters of frame; what cannot be cut to anything is passed over.
    """
    rows = _sections(spark, sf_dir).withColumn("pack", F.lit(1))
    cut = lambda t, left: values.natural_cut(t, left, ("。", "\n"), least=2)
    return retrieval.budgeted(rows, ["pack"], ["rank", "memory_id", "message_id"], "text", 12_000, 1, cut, frame=80).drop("pack")


#: Shares of a project pack's characters (fixed values).
SHARES = {"core": 0.35, "decisions": 0.125, "tasks": 0.125, "recent": 0.2, "related": 0.2}


@query()
def project_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lists of a project, each within its share of the budget; a list ends where less than eighty characters are left."""
    m = memories(spark, sf_dir).filter("project = 'p3' and status = 'active'")
    kinds = {"core": m.filter("tier = 'core'"), "decisions": m.filter("memory_type = 'decision'"), "tasks": m.filter("memory_type = 'preference'"), "recent": m.filter("tier = 'pinned'"), "related": m.filter(F.contains(F.lower("text"), F.lit("heed")))}
    out = None
    for name, rows in kinds.items():
        first = rows.orderBy(F.desc("importance"), "memory_id").limit(40).select(F.lit(name).alias("kind"), (-F.col("importance")).alias("by"), "memory_id", "text")
        part = retrieval.budgeted(first, ["kind"], ["by", "memory_id"], "text", int(6000 * SHARES[name]), 80, lambda t, left: values.natural_cut(t, left)).drop("by")
        out = part if out is None else out.unionByName(part)
    return out
