"""Cards, facts, measurements, manifests, lookups and small text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import textfns
from palimpsest.operators import merge, review, search
from palimpsest.plans.registry import query
from palimpsest.plans.search_queries import QUERY_VECTOR, _vector_sql
from palimpsest.plans.tables import jobs, memories, messages, spread, table


@query("""
select project, count(*) as n, case when bool_or(status = '') then null else count(*) filter (where status = 'active') end as active from memories
  group by project
""")
def card_summary_unmeasured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure is null where any of its rows was not measured."""
    return memories(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"), review.unless_unknown(F.col("status") == "", F.count_if(F.col("status") == "active")).alias("active"))


@query("""
select source_id, case when count(*) filter (where status = 'failed') * 2 > count(*) then 'failing' when bool_or(status = 'failed') then 'degraded'
  else 'healthy' end as health from jobs group by source_id
""")
def overall_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return jobs(spark, sf_dir).groupBy("source_id").agg(F.when(failed * 2 > F.count("*"), "failing").when(failed > 0, "degraded").otherwise("healthy").alias("health"))


@query("select title, arg_min(memory_id, struct_pack(a := importance, b := memory_id)) as owner from memories group by title")
def first_title_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy("title").agg(F.min_by("memory_id", F.struct("importance", "memory_id")).alias("owner"))


@query("""
select day, cast(n as bigint) as promoted, n >= 10 as limit_reached from (select cast(made_at // 86400000000 as bigint) as day, count(*) as n from
  jobs where status = 'completed' group by 1)
""")
def daily_promotion_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jobs(spark, sf_dir).filter("status = 'completed'").groupBy(F.floor(F.col("made_at") / 86_400_000_000).alias("day")).agg(F.count("*").alias("promoted"))
    return done.withColumn("limit_reached", F.col("promoted") >= 10)


@query("""
with r as (select title, memory_id, row_number() over (partition by title order by importance desc, memory_id desc) as place, count(*) over (partition
  by title) as n from memories) :: select title, memory_id, n from r where place <= 8
""")
def newest_notes_per_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("title", "memory_id", "importance")
    n = rows.groupBy("title").agg(F.count("*").alias("n"))
    return merge.newest(rows, ["title"], [F.desc("importance"), F.desc("memory_id")], 8).join(n, "title").select("title", "memory_id", "n")


@query("""
select count(*) as n, count(*) - count(distinct sha256(text)) as repeated, count(*) - count(distinct doc_id) as repeated_ids from documents where text
  is not null
""")
def duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(F.sha2(F.col("text").cast("binary"), 256))).alias("repeated"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"))


@query("select lang, source, count(*) as files, cast(sum(n_chars) as bigint) as size from documents group by rollup (lang, source)")
def inventory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))


@query("select job_id, path, count(*) over (partition by path) as rounds from jobs where status = 'failed'")
def rounds_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).filter("status = 'failed'").select("job_id", "path")
    return rows.join(rows.groupBy("path").agg(F.count("*").alias("rounds")), "path").select("job_id", "path", "rounds")


@query("""
with w as (select path, made_at, lag(made_at) over (partition by path order by job_id) as before from jobs) :: select path, bool_and(before is null or
  before <= made_at) as ordered from w group by path
""")
def time_order_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("made_at").over(Window.partitionBy("path").orderBy("job_id"))
    return jobs(spark, sf_dir).select("path", "made_at", before.alias("before")).groupBy("path").agg(F.bool_and(F.col("before").isNull() | (F.col("before") <= F.col("made_at"))).alias("ordered"))


@query("""
with g as (select sha256(text) as h, count(distinct source) as n, min(doc_id) as first_id from documents where text is not null group by 1) :: select
  first_id, n from g where n >= 2
""")
def equal_content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contents that come from two sources or more."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.count_distinct("source").alias("n"), F.min("doc_id").alias("first_id")).filter("n >= 2").select("first_id", "n")


@query("""
select title, count(distinct conflict_key) as facts, count(distinct conflict_key) > 1 as contradicts from memories where conflict_key <> '' group by
  title
""")
def identity_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter("conflict_key <> ''").groupBy("title").agg(F.count_distinct("conflict_key").alias("facts")).withColumn("contradicts", F.col("facts") > 1)


@query("select distinct k as raw_id from jobs where status in ('queued', 'running', 'retrying') and k is not null")
def protected_raw_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter("status in ('queued', 'running', 'retrying') and k is not null").select(F.col("k").alias("raw_id")).distinct()


@query("""
with l as (select k as candidate, arg_max(status, job_id) as status, max(job_id) as last_id from jobs where k is not null group by k) :: select
  candidate, status, last_id from l where status <> 'completed' and not exists (select 1 from memories m where m.memory_id = candidate and m.tier =
  'core')
""")
def pending_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = jobs(spark, sf_dir).filter("k is not null").groupBy(F.col("k").alias("candidate")).agg(F.max_by("status", "job_id").alias("status"), F.max("job_id").alias("last_id"))
    known = memories(spark, sf_dir).filter("tier = 'core'").select(F.col("memory_id").alias("candidate"))
    return last.filter("status <> 'completed'").join(known, "candidate", "left_anti")


@query("""
with c as (select conversation_id, string_agg(message_id, ',' order by sequence) filter (where sequence < 3) as first_messages from messages group by
  conversation_id) :: select conversation_id, first_messages from c where not exists (select 1 from memories m where m.memory_id = c.conversation_id
  and m.review = 'approved')
""")
def evidence_only_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("sequence") < 3, F.struct("sequence", "message_id")))), lambda x: x.message_id)
    cards = messages(spark, sf_dir).groupBy("conversation_id").agg(F.array_join(first, ",").alias("first_messages"))
    done = memories(spark, sf_dir).filter("review = 'approved'").select(F.col("memory_id").alias("conversation_id"))
    return cards.join(done, "conversation_id", "left_anti").withColumn("first_messages", F.nullif("first_messages", F.lit("")))


@query("""
with m as (select path, min(job_id) as first_job from jobs where job_id % 2 = 0 group by path), j as (select path, max(job_id) as last_job from jobs
  where job_id % 3 = 0 group by path) :: select coalesce(m.path, j.path) as path, coalesce(m.first_job, j.last_job) as job_id, m.path is not null as
  in_manifest from m full join j on j.path = m.path
""")
def manifest_and_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the manifest, and of jobs that it does not list; the manifest's values win."""
    rows = jobs(spark, sf_dir)
    m = rows.filter("job_id % 2 = 0").groupBy("path").agg(F.min("job_id").alias("first_job"))
    j = rows.filter("job_id % 3 = 0").groupBy("path").agg(F.max("job_id").alias("last_job"))
    return m.join(j, "path", "full_outer").select("path", F.coalesce("first_job", "last_job").alias("job_id"), F.col("first_job").isNotNull().alias("in_manifest"))


@query("select d.doc_id, count(c.turn) as chunks from documents d left join conversations c on c.conv_id = d.doc_id group by d.doc_id")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without chunks are kept with zero. Counted before the join, so only counts meet documents."""
    counts = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("turn").alias("chunks"))
    return table(spark, sf_dir, "documents").select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"))


@query("""
select job_id, 'src' || cast(job_id % 20 as varchar) as a, source_id as b from jobs where 'src' || cast(job_id % 20 as varchar) = 'src7' or source_id
  = 's7'
""")
def relation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with a node at either end: a filter with OR, one scan."""
    rows = jobs(spark, sf_dir).select("job_id", F.concat(F.lit("src"), F.col("job_id") % 20).alias("a"), F.col("source_id").alias("b"))
    return rows.filter("a = 'src7' or b = 's7'")


@query("""
select m.memory_id, p.n_members, t.top from memories m left join (select project, count(*) as n_members from memories where tier = 'core' group by
  project) p on p.project = m.project left join (select title, max(authority) as top from memories where status = 'active' group by title) t on
  t.title = m.title
""")
def left_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    p = m.filter("tier = 'core'").groupBy("project").agg(F.count("*").alias("n_members"))
    t = m.filter("status = 'active'").groupBy("title").agg(F.max("authority").alias("top"))
    return m.select("memory_id", "project", "title").join(p, "project", "left").join(t, "title", "left").select("memory_id", "n_members", "top")


@query("select memory_id, max(score) as score from (select memory_id, 0.55::double as score from memories where contains(lower(text), 'heed') union all select memory_id, 0.65::double from memories where contains(lower(title), 'src1') union all select vec_id, round(0.7 * score, 4) from (" + _vector_sql("cosine", 50) + ") where score > 0) group by memory_id")
def legacy_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several lists with scores of their own; a row keeps its best."""
    m = memories(spark, sf_dir)
    near = search.vector_topk(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 50).withColumn("score", F.round("score", 6))
    lists = [
        m.filter(F.contains(F.lower("text"), F.lit("heed"))).select("memory_id", F.lit(0.55).alias("score")), m.filter(F.contains(F.lower("title"), F.lit("src1"))).select("memory_id", F.lit(0.65)),
        near.filter("score > 0").select("vec_id", F.round(0.7 * F.col("score"), 4)),
    ]
    return lists[0].union(lists[1]).union(lists[2]).groupBy("memory_id").agg(F.max("score").alias("score"))


@query("""
with recursive r as (
  select memory_type, memory_id, cast(ceil(length(text) / 3) as bigint) as cost, row_number() over (partition by memory_type order by authority desc, memory_id) as place
  from (select * from memories where tier = 'core' order by authority desc, memory_id limit 60)),
f as (select memory_type, 0::bigint as place, 0::bigint as used, false as kept, 0::bigint as memory_id from (select distinct memory_type from r)
  union all select f.memory_type, f.place + 1, f.used + case when f.used + r.cost <= 3000 then r.cost else 0 end, f.used + r.cost <= 3000, r.memory_id from f join r on r.memory_type = f.memory_type and r.place = f.place + 1)
:: select memory_type, memory_id, used from f where kept
""")
def legacy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by kind within a budget of three characters a token; one that is too big is skipped and later ones may still fit."""
    rows = memories(spark, sf_dir).filter("tier = 'core'").orderBy(F.desc("authority"), "memory_id").limit(60)
    return review.pack_skipping(rows, "memory_type", [F.desc("authority"), F.col("memory_id")], F.ceil(F.length("text") / 3), 3000, "memory_id")


@query("""
select memory_id, round(least(0.95, 0.5 + case when length(text) > 100 then 0.15 else 0 end + case when length(tags) > 100 then 0.15 else 0 end + case
  when project = 'p1' then 0.05 else 0 end + case when title = 'src1' then 0.05 else 0 end + case when importance <= 2 then 0.1 else 0 end)::double,
  2) as score from memories
""")
def opportunity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = review.opportunity_score(F.col("text"), F.col("tags"), F.col("project") == "p1", F.col("title") == "src1", F.col("importance"))
    return memories(spark, sf_dir).select("memory_id", score.alias("score"))


@query("""
select memory_id, cast(contains(lower(text), 'heed') as int) + cast(contains(lower(text), 'tion') as int) + cast(contains(lower(text), 'src') as int)
  >= 2 as covered from memories
""")
def majority_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(F.lit("heed"), F.lit("tion"), F.lit("src"))
    return memories(spark, sf_dir).select("memory_id", (F.size(F.filter(points, lambda p: F.contains(F.lower("text"), p))) * 2 >= F.size(points)).alias("covered"))


@query("select job_id, regexp_extract(path, '[^/]*$') as name, regexp_matches(path, '^[^/.][^/]*(/[^/.][^/]*)*$') as fine from jobs")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base name, and whether a path is relative, without empty, dot or hidden parts."""
    return jobs(spark, sf_dir).select("job_id", textfns.basename(F.col("path")).alias("name"), F.col("path").rlike(r"^[^/.][^/]*(/[^/.][^/]*)*$").alias("fine"))


@query("""
with w as (select source_id, max(made_at) as last_at, greatest(60, max(value) / 2.5 / 0.25) as throttle from jobs group by source_id), n as (select
  max(made_at) as now from jobs) :: select source_id, round(throttle, 4) as throttle, (now - last_at) / 1000000 >= throttle as due from w, n
""")
def adaptive_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is due once its last snapshot is older than a base or than its largest item takes at the given rate and share."""
    rows = jobs(spark, sf_dir)
    w = rows.groupBy("source_id").agg(F.max("made_at").alias("last_at"), F.greatest(F.lit(60.0), F.max("value") / 2.5 / 0.25).alias("throttle"))
    now = rows.agg(F.max("made_at").alias("now"))
    return w.crossJoin(F.broadcast(now)).select("source_id", F.round("throttle", 4).alias("throttle"), ((F.col("now") - F.col("last_at")) / 1_000_000 >= F.col("throttle")).alias("due"))


@query("select d.doc_id from documents d where not exists (select 1 from embeddings e where e.vec_id = d.doc_id) order by d.doc_id limit 64")
def backfill_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one bounded round of a backfill takes on."""
    return merge.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").orderBy("doc_id").limit(64)


@query("""
with x as (select conv_id, list_sort(list(distinct role)) as roles from conversations group by conv_id) :: select conv_id,
  cast(len(list_intersect(roles, ['user', 'tool'])) as int) as met, cast(len(roles) as int) as n from x
""")
def role_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", F.size(F.array_intersect("roles", F.array(F.lit("user"), F.lit("tool")))).alias("met"), F.size("roles").alias("n"))


@query("""
select page_id, case when contains(regexp_extract(url, '://([^/]*)', 1), 'wiki') then 'wiki' when contains(regexp_extract(url, '://([^/]*)', 1),
  'news') then 'news' else 'web' end as platform from pages
""")
def page_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"://([^/]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.contains(host, F.lit("wiki")), "wiki").when(F.contains(host, F.lit("news")), "news").otherwise("web").alias("platform"))


@query()
def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a core memory duplicates: by containment, by summary and points (lines), or by matching blocks from 0.88 on."""
    rows = spread(memories(spark, sf_dir).select("memory_id", "tier", "text"))
    lines = F.transform(F.split("text", "\n"), textfns.letters_only)
    told = rows.select("memory_id", "tier", textfns.letters_only(F.coalesce("text", F.lit(""))).alias("text"), F.get(lines, F.lit(0)).alias("summary"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("points"))
    core = told.filter("tier = 'core'").select(F.col("memory_id").alias("core_id"), "text")
    return review.full_text_duplicates(told.filter("tier <> 'core'"), core, "memory_id")


@query("""
with c as (select *, memory_id % 6 as day, count(*) over (partition by text) > 1 and memory_id > min(memory_id) over (partition by text) as dup, case
  when memory_id % 8 = 0 then null else (memory_id % 50)::double / 50 end as alike, case when memory_type = 'knowledge' then 'category' end as r1,
  case when memory_id % 31 = 0 then 'notification' end as r2, case when memory_id % 40 < 10 then 'confidence' end as r3 from memories), g as (select
  *, case when status = '' then 'rejected:schema' when memory_id % 29 = 0 then 'rejected:process_log' when dup then 'rejected:duplicate' when
  memory_id % 23 = 0 then 'review:title_conflict' when alike is null then 'deferred:no_similarity' when alike >= 0.92 then
  'rejected:semantic_duplicate' when concat_ws('+', r1, r2, r3) <> '' then 'review:' || concat_ws('+', r1, r2, r3) end as gate from c) :: select
  memory_id, coalesce(gate, case when row_number() over (partition by gate is null, day order by importance desc, memory_id) <= 10 then 'promoted'
  else 'deferred:daily_limit' end) as outcome from g
""")
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("memory_id")
    rows = memories(spark, sf_dir).withColumn("_h", F.sha2(F.col("text").cast("binary"), 256))
    first = rows.groupBy("_h").agg(F.min("memory_id").alias("first_id"))
    tested = rows.join(first, "_h", "left").select(
        "memory_id", "importance", (i % 6).alias("day"), (F.col("status") != "").alias("schema_ok"), (i % 29 == 0).alias("process_log"), (F.col("memory_type") != "knowledge").alias("category_ok"), (i % 31 == 0).alias("notification"),
        F.when(i % 40 < 10, 0.5).otherwise(0.95).alias("confidence"), F.coalesce(i > F.col("first_id"), F.lit(False)).alias("duplicate"), (i % 23 == 0).alias("title_conflict"), F.when(i % 8 != 0, (i % 50) / 50).alias("similarity"),
    )
    return review.promotion_outcome(tested, ["day"], [F.desc("importance"), F.col("memory_id")]).select("memory_id", "outcome")
