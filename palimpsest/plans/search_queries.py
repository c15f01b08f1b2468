"""Retrieval, views in time, scopes, listings, packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.timefns import validity_reason
from palimpsest.operators import merge, search
from palimpsest.plans.registry import query
from palimpsest.plans.tables import memories, messages, spread, table

QUERY_VECTOR = [((7 * i) % 11 - 5) / 10 for i in range(64)]
AS_OF = "2026-01-20T00:00:00Z"

_OCC = "(length({c}) - length(replace({c}, '{t}', ''))) / {n}"
_SIZE = "(greatest(length(title) - 2, 0) + greatest(length(heading) - 2, 0) + greatest(length(text) - 2, 0) + greatest(length(tags) - 2, 0))"


def _bm25_sql(terms: list[str]) -> str:
    """BM25 of terms that do not overlap themselves, so that occurrences are what replacing them removes."""
    tf = {t: "(" + " + ".join(f"{w} * " + _OCC.format(c=f"lower({c})", t=t, n=len(t)) for c, w in search.WEIGHTS.items()) + ")" for t in terms}
    has = {t: "(" + " or ".join(f"contains(lower({c}), '{t}')" for c in search.WEIGHTS) + ")" for t in terms}
    stats = f"select count(*) as n, avg({_SIZE}) as av, " + ", ".join(f"count(*) filter (where {has[t]}) as n{i}" for i, t in enumerate(terms)) + " from memories"
    idf = lambda i: f"(case when ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 then 1e-6 else ln((n - n{i} + 0.5) / (n{i} + 0.5)) end)"
    score = " + ".join(f"{idf(i)} * {tf[t]} * 2.2 / ({tf[t]} + 1.2 * (0.25 + 0.75 * {_SIZE} / av))" for i, t in enumerate(terms))
    return f"stats as ({stats}), scored as (select *, -({score}) as bm25 from memories, stats where {' and '.join(has.values())})"


@query(f"""
with {_bm25_sql(['heed', 'tion'])} :: select chunk_id, round(bm25, 6) as bm25, round(1 / (1 + abs(bm25)), 6) as lexical_score from scored order by
  scored.bm25, chunk_id limit 20
""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.lexical(spread(memories(spark, sf_dir)), ["heed", "tion"], limit=20)
    return hits.select("chunk_id", F.round("bm25", 6).alias("bm25"), F.round("lexical_score", 6).alias("lexical_score"))


@query(f"with {_bm25_sql(['heed', 'tion'])} :: select chunk_id, round(bm25, 6) as bm25 from scored order by scored.bm25, chunk_id limit 20")
def lexical_search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through a trigram index."""
    rows = spread(memories(spark, sf_dir))
    return search.lexical(rows, ["heed", "tion"], limit=20, postings=search.trigram_postings(rows)).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(f"""
with {_bm25_sql(['heed'])} :: select chunk_id, round(bm25, 6) as bm25 from scored where privacy = 'private' order by scored.bm25, chunk_id limit 15
""")
def lexical_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters choose rows, but statistics stay those of the whole table."""
    hits = search.lexical(memories(spark, sf_dir), ["heed"], F.col("privacy") == "private", limit=15)
    return hits.select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query("""
select chunk_id from memories where contains(lower(title || ' ' || heading || ' ' || text || ' ' || tags), 'an') and contains(lower(title || ' ' ||
  heading || ' ' || text || ' ' || tags), 'src1')
""")
def lexical_fallback_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring(memories(spark, sf_dir), ["an", "src1"]).select("chunk_id")


@query("""
select chunk_id, cast(case when contains(lower(title), 'src3') then 1 else 0 end as int) as title_hit from memories where contains(lower(title || ' '
  || heading || ' ' || text || ' ' || tags), 'src3') and contains(lower(title || ' ' || heading || ' ' || text || ' ' || tags), 'de')
""")
def substring_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring(memories(spark, sf_dir), ["src3", "de"]).select("chunk_id", F.greatest(F.contains(F.lower("title"), F.lit("src3")).cast("int"), F.lit(0)).alias("title_hit"))


def _vector_sql(metric: str, k: int = 10) -> str:
    q = "[" + ", ".join(f"{x}::double" for x in QUERY_VECTOR) + "]"
    v = "list_transform(embedding, lambda x: x::double)"
    both = f"list_zip({v}, {q})"
    e = {
        "dot": f"list_sum(list_transform({both}, lambda p: p[1] * p[2]))",
        "euclid": f"-sqrt(list_sum(list_transform({both}, lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
        "manhattan": f"-list_sum(list_transform({both}, lambda p: abs(p[1] - p[2])))",
    }
    norm = f"(sqrt(list_sum(list_transform({v}, lambda x: x * x))) * {sum(x * x for x in QUERY_VECTOR) ** 0.5}::double)"
    e["cosine"] = f"case when {norm} > 0 then {e['dot']} / {norm} else 0 end"
    return f"select vec_id, round(score, 6) as score from (select vec_id, {e[metric]} as score from embeddings) order by embeddings_score desc, vec_id limit {k}".replace("embeddings_score", "score")


def _vector(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.vector_topk(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 10, metric).select("vec_id", F.round("score", 6).alias("score"))

    run.__name__ = f"vector_topk_{metric}"
    return query(_vector_sql(metric))(run)


vector_topk_cosine, vector_topk_dot, vector_topk_euclid, vector_topk_manhattan = map(_vector, ("cosine", "dot", "euclid", "manhattan"))


def _ranked(df: DataFrame, order: list[Column], n: int, key: str = "chunk_id") -> DataFrame:
    """The first n rows with their rank; the window is made over the n rows of a top-k only."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select(key, "rank")


_HYBRID = (
    f"{_bm25_sql(['heed'])}, lex as (select chunk_id, row_number() over (order by bm25, chunk_id) as rank from (select * from scored order by bm25, chunk_id limit 30)), "
    f"near as (select vec_id as chunk_id, row_number() over (order by score desc, vec_id) as rank from ({_vector_sql('cosine', 30)})), "
    "fused as (select chunk_id, sum(1.0::double / (60 + rank)) as rrf, string_agg(channel, ',' order by channel) as channels from (select *, 'lexical' as channel from lex union all select *, 'semantic' from near) group by chunk_id)"
)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = _ranked(search.lexical(spread(memories(spark, sf_dir)), ["heed"]), [F.col("bm25"), F.col("chunk_id")], 30)
    near = search.vector_topk(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 30).select(F.col("vec_id").alias("chunk_id"), F.round("score", 6).alias("score"))
    return search.fuse({"lexical": lex, "semantic": _ranked(near, [F.desc("score"), F.col("chunk_id")], 30)})


@query(f"with {_HYBRID} :: select chunk_id, round(rrf, 8) as rrf, channels from fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("chunk_id", F.round("rrf", 8).alias("rrf"), F.array_join("channels", ",").alias("channels"))


_BOOST = (
    "least((case when contains(lower(title), 'src1') then 0.025::double else 0 end) + (case when contains(lower(title), 'en') then 0.025::double else 0 end), 0.10::double)"
    " + least((case when contains(lower(heading), 'src1') then 0.012::double else 0 end) + (case when contains(lower(heading), 'en') then 0.012::double else 0 end), 0.05::double)"
    " + least((case when contains(lower(tags), 'src1') then 0.008::double else 0 end) + (case when contains(lower(tags), 'en') then 0.008::double else 0 end), 0.03::double)"
    " + (case tier when 'core' then 0.035::double when 'pinned' then 0.025::double else 0 end) + importance * 0.004::double"
    " + least(greatest((case when weight = 0 then 1 else weight end) - 1, -0.5::double), 2.0::double) * 0.01::double"
    " + (case when status = 'active' then 0.008::double else 0 end) + (case when review = 'approved' then 0.008::double else 0 end) + authority * 0.02::double"
)


@query(f"select chunk_id, round({_BOOST}, 8) as boost from memories")
def metadata_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("chunk_id", F.round(search.metadata_boost(["src1", "en"]), 8).alias("boost"))


@query("""
select chunk_id from (select chunk_id, row_number() over (partition by project, memory_type order by authority desc, importance desc, chunk_id) as
  place from memories) where place <= 3
""")
def per_memory_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).withColumn("group", F.struct("project", "memory_type"))
    return search.cap_per_memory(rows, 3, "group", [F.desc("authority"), F.desc("importance"), F.col("chunk_id")]).select("chunk_id")


@query("""
select chunk_id, authority from (select *, max(authority) over (partition by project, memory_type, conflict_key) as top from memories) where
  conflict_key = '' or authority >= top
""")
def authority_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.resolve_authority(memories(spark, sf_dir), ["project", "memory_type"]).select("chunk_id", "authority")


@query("""
select chunk_id, channel, cast(place as int) as place from (select *, row_number() over (partition by channel order by authority desc, chunk_id) as
  place from (select *, case when tier = 'normal' then 'evidence' else 'memory' end as channel from memories)) where place <= 25
""")
def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.channel_split(memories(spark, sf_dir), F.col("tier") == "normal", 25, [F.desc("authority"), F.col("chunk_id")]).select("chunk_id", "channel", "place")


def _reason_sql(mode: str) -> str:
    zoned = lambda c: f"regexp_matches({c}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$')"
    at = lambda c: f"(case when {zoned(c)} then try_cast({c} as timestamptz) end)"
    start = "case when status = '' and %s then 'missing_status' when valid_from is not null and {f} is null then 'malformed_valid_from' when valid_to is not null and {t} is null then 'malformed_valid_to'".format(f=at("valid_from"), t=at("valid_to")) % ("false" if mode == "history" else "true")
    if mode == "history":
        return f"select memory_id, {start} else 'history_requested' end as reason from memories"
    hidden = "status in ('superseded', 'invalidated', 'archived', 'rejected', 'preparing', 'repair_required', 'rolled_back')" if mode == "current" else "status in ('rejected', 'preparing', 'repair_required', 'rolled_back')"
    return f"select memory_id, {start} when {hidden} then 'status_' || status when {at('valid_from')} > timestamptz '2026-01-20 00:00:00+00' then 'not_yet_valid' when {at('valid_to')} <= timestamptz '2026-01-20 00:00:00+00' then 'expired' else '{'currently_valid' if mode == 'current' else 'valid_at_requested_time'}' end as reason from memories"


def _temporal(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        instant = F.to_timestamp(F.lit(AS_OF))
        return memories(spark, sf_dir).select("memory_id", validity_reason(F.col("status"), F.col("valid_from"), F.col("valid_to"), mode, instant).alias("reason"))

    run.__name__ = f"temporal_{mode}"
    return query(_reason_sql(mode))(run)


temporal_current, temporal_as_of, temporal_history = map(_temporal, ("current", "as_of", "history"))


@query("""
select memory_id from memories where (tier = 'core' and review = 'approved') or title in (select title from memories group by title having count(*)
  filter (where authority >= 30) * 2 >= count(*))
""")
def source_authority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    trusted = rows.groupBy("title").agg(F.count_if(F.col("authority") >= 30).alias("a"), F.count("*").alias("n")).filter("a * 2 >= n").select("title", F.lit(True).alias("trusted"))
    return rows.join(trusted, "title", "left").filter(F.col("trusted") | ((F.col("tier") == "core") & (F.col("review") == "approved"))).select("memory_id")


@query("select memory_id, scope = '' or scope = 'all' or scope = 'a2,all' as searched, scope = '' as listed, scope <> 'a1' as for_a2 from memories")
def scope_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scopes")
    return memories(spark, sf_dir).select("memory_id", search.scope_visible(s, None).alias("searched"), search.scope_visible(s, None, listing=True).alias("listed"), search.scope_visible(s, "a2").alias("for_a2"))


@query("""
select memory_id from memories where contains(lower(project), 'p1') and privacy in ('private') and memory_type = 'decision' and regexp_matches(tags,
  '(^| )en( |$)')
""")
def post_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.split(F.lower("tags"), " ")
    return memories(spark, sf_dir).filter(F.contains(F.lower("project"), F.lit("p1")) & F.col("privacy").isin("private") & (F.col("memory_type") == "decision") & (F.size(F.array_except(F.array(F.lit("en")), tags)) == 0)).select("memory_id")


@query("""
select message_id, conversation_id, sequence, n_all from (select *, count(*) over () as n_all from messages where role = 'user') order by made_at
  desc, sequence desc, message_id desc limit 20 offset 40
""")
def messages_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).filter("role = 'user'")
    total = rows.agg(F.count("*").alias("n_all"))
    page = rows.orderBy(F.desc("made_at"), F.desc("sequence"), F.desc("message_id")).offset(40).limit(20)
    return page.crossJoin(F.broadcast(total)).select("message_id", "conversation_id", "sequence", "n_all")


@query("""
select conversation_id, max(made_at) as last_at, count(*) as message_count from messages group by conversation_id order by last_at desc,
  conversation_id desc limit 25
""")
def conversations_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("conversation_id").agg(F.max("made_at").alias("last_at"), F.count("*").alias("message_count")).orderBy(F.desc("last_at"), F.desc("conversation_id")).limit(25)


@query("select title as source, count(*) as n, max(memory_id) as last_id from memories group by title order by last_id desc, source limit 10")
def sources_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy(F.col("title").alias("source")).agg(F.count("*").alias("n"), F.max("memory_id").alias("last_id")).orderBy(F.desc("last_id"), "source").limit(10)


@query("""
select memory_id, title, status from memories where privacy = 'private' and status in ('active', 'archived') and project = 'p3' and title ilike
  '%SRC1%' and valid_from is not null and valid_from >= '2026-01-05' order by importance desc, memory_id limit 50
""")
def inspector_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).filter((F.col("privacy") == "private") & F.col("status").isin("active", "archived") & (F.col("project") == "p3") & F.col("title").ilike("%SRC1%") & (F.col("valid_from") >= "2026-01-05"))
    return rows.orderBy(F.desc("importance"), "memory_id").limit(50).select("memory_id", "title", "status")


@query("""
select memory_id, weight, importance from memories where tier = 'core' and status not in ('superseded', 'archived') order by weight desc, importance
  desc, memory_id limit 30
""")
def core_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).filter((F.col("tier") == "core") & ~F.col("status").isin("superseded", "archived"))
    return rows.orderBy(F.desc("weight"), F.desc("importance"), "memory_id").limit(30).select("memory_id", "weight", "importance")


@query("select memory_id, valid_from from memories order by valid_from desc nulls last, memory_id desc limit 30")
def recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).orderBy(F.desc_nulls_last("valid_from"), F.desc("memory_id")).limit(30).select("memory_id", "valid_from")


@query("""
with s as (select source, count(*) as n_docs from documents group by source), c as (select conv_id, 'src' || cast(conv_id % 20 as varchar) as source,
  max(turn) as turns from conversations group by conv_id) :: select m.conv_id, m.turn, c.turns, s.n_docs from conversations m join c using (conv_id)
  join s using (source)
""")
def message_three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations")
    c = m.groupBy("conv_id").agg(F.max("turn").alias("turns")).withColumn("source", F.concat(F.lit("src"), F.col("conv_id") % 20))
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"))
    return m.join(c, "conv_id").join(s, "source").select("conv_id", "turn", "turns", "n_docs")


@query("""
select d.memory_id, m.message_id from memories d join messages m on m.conversation_id = d.memory_id % 100 and m.sequence = 1 where d.privacy =
  'private' and d.scope in ('', 'all', 'a2,all') and lower(d.project) = 'p3'
""")
def linked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = memories(spark, sf_dir).filter((F.col("privacy") == "private") & search.scope_visible(F.col("scopes"), None) & (F.lower("project") == "p3"))
    m = messages(spark, sf_dir).filter("sequence = 1")
    return d.join(m, d.memory_id % 100 == m.conversation_id).select("memory_id", "message_id")


@query("""
with items as (select 'memory' as kind, memory_id as id, importance as made_at, length(title) + 1 as cost from memories where tier = 'core' union all
  select 'message', conversation_id, sequence, length(role) + 1 from messages where sequence < 2), timed as (select *, sum(cost) over (order by
  made_at desc, kind, id rows unbounded preceding) as upto, row_number() over (order by made_at desc, kind, id) as place from items) :: select kind,
  id, cast(place as int) as place from timed where upto <= 400 or place = 1
""")
def timeline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest items of both lists until a budget is used; the first one always stays.

    Each item costs one at least, so no more than the budget can stay, and the window is over that many rows.
    """
    a = memories(spark, sf_dir).filter("tier = 'core'").select(F.lit("memory").alias("kind"), F.col("memory_id").alias("id"), F.col("importance").cast("bigint").alias("made_at"), (F.length("title") + 1).alias("cost"))
    b = messages(spark, sf_dir).filter("sequence < 2").select(F.lit("message").alias("kind"), F.col("conversation_id").alias("id"), F.col("sequence").alias("made_at"), (F.length("role") + 1).alias("cost"))
    order = [F.desc("made_at"), F.col("kind"), F.col("id")]
    first = a.unionByName(b).orderBy(*order).limit(401)
    timed = first.withColumn("upto", F.sum("cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return timed.filter("upto <= 400 or place = 1").select("kind", "id", "place")


def _pack(spark: SparkSession, sf_dir: str, budget: int, memory_of: str = "title") -> DataFrame:
    """Sections in order of kind and id, added while they fit: one that does not fit is skipped, later ones may still."""
    kinds = F.when(F.col("memory_type") == "decision", 0).when(F.col("memory_type") == "preference", 1).otherwise(9)
    rows = memories(spark, sf_dir).filter("tier <> 'normal'").orderBy(F.desc("authority"), "memory_id").limit(40)
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(kinds.alias("kind"), "memory_id", F.length("text").alias("size")))).alias("s"))
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fold = F.aggregate("s", state, lambda a, x: F.when(a.used + x["size"] <= budget, F.struct((a.used + x["size"]).alias("used"), F.array_append(a.ids, x.memory_id).alias("ids"))).otherwise(a))
    return listed.select(F.posexplode(fold.ids).alias("place", "memory_id"))


@query("""
with recursive k as (select *, case memory_type when 'decision' then 0 when 'preference' then 1 else 9 end as kind from (select * from memories where tier <> 'normal' order by authority desc, memory_id limit 40)),
r as (select memory_id, length(text) as size, row_number() over (order by kind, memory_id) as place from k),
f as (select 0::bigint as place, 0::bigint as used, false as kept, 0::bigint as memory_id
  union all select f.place + 1, f.used + case when f.used + r.size <= 12000 then r.size else 0 end, f.used + r.size <= 12000, r.memory_id from f join r on r.place = f.place + 1)
:: select cast(row_number() over (order by place) - 1 as int) as place, memory_id from f where kept
""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir, 12_000)


@query("""
select 'memory' as kind, memory_id as id from memories where status = 'active' union all select 'message', made_at from messages union all select
  'job', event_id from events where event_type = 'error'
""")
def activity_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [memories(spark, sf_dir).filter("status = 'active'").select(F.lit("memory").alias("kind"), F.col("memory_id").alias("id")), messages(spark, sf_dir).select(F.lit("message"), "made_at"), table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit("job"), "event_id")]
    return reduce(DataFrame.union, parts)


@query("""
with p as (select distinct project from memories) :: select project, (select count(*) from memories m where m.project = p.project) as memories,
  (select count(*) from memories m where m.project = p.project and m.tier = 'core') as core, (select count(*) from messages x where 'p' ||
  cast(x.conversation_id % 9 as varchar) = p.project) as messages from p
""")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).groupBy("project").agg(F.count("*").alias("memories"), F.count_if(F.col("tier") == "core").alias("core"))
    x = messages(spark, sf_dir).groupBy(F.concat(F.lit("p"), F.col("conversation_id") % 9).alias("project")).agg(F.count("*").alias("messages"))
    return m.join(x, "project", "left").select("project", "memories", "core", F.coalesce("messages", F.lit(0)).cast("bigint").alias("messages"))


_COS = (
    "list_sum(list_transform(list_zip(list_transform(embedding, lambda x: x::double), {q}), lambda p: p[1] * p[2]))"
    " / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * {n}::double)"
)
_SCORE = f"least(1, 4 * abs({_COS.format(q='[' + ', '.join(f'{x}::double' for x in QUERY_VECTOR) + ']', n=sum(x * x for x in QUERY_VECTOR) ** 0.5)}))"


@query(f"""
with e as (select vec_id, round({_SCORE}, 3) as score, trim(source) as content, trim('a note of src1') as query from embeddings join documents on doc_id = vec_id) ::
select vec_id, score from e where score >= 0.55 and (score < 0.999 or (query <> '' and content <> '' and (contains(query, content) or contains(content, query))))
""")
def recall_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are cosines, spread so that near-perfect ones occur; those stay only if query and content hold one another."""
    score = F.round(F.least(F.lit(1.0), 4 * F.abs(search.similarity(F.col("embedding"), QUERY_VECTOR))), 3)
    e = table(spark, sf_dir, "embeddings").select("vec_id", score.alias("score"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("content"))
    return e.join(d, "vec_id").filter(search.plausible_recall(F.col("score"), F.lit("a note of src1"), F.col("content"))).select("vec_id", "score")


@query("""
select coalesce(m.project, x.project) as project, case when m.project is null then 'removed' when x.project is null then 'added' when m.n = x.n then
  'unchanged' else 'updated' end as change from (select project, count(*) as n from memories where memory_id % 2 = 0 and project < 'p7' group by
  project) x full join (select project, count(*) as n from memories where memory_id % 3 = 0 and project > 'p0' group by project) m on m.project =
  x.project
""")
def diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    before = rows.filter("memory_id % 2 = 0 and project < 'p7'").groupBy("project").agg(F.count("*").alias("n"))
    after = rows.filter("memory_id % 3 = 0 and project > 'p0'").groupBy("project").agg(F.count("*").alias("n"))
    return merge.diff(before, after, "project", "n")
