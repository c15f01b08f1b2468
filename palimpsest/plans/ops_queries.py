"""Queues, failures, facts, retention, merges, review, evaluation, sources and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import textfns
from palimpsest.functions.timefns import backoff_seconds, micros, percent
from palimpsest.operators import merge, ops
from palimpsest.plans.registry import query
from palimpsest.plans.tables import jobs, memories, messages, spread, table
from palimpsest.sources import chunking, history


# queues and jobs


@query("""
with st as (select unnest(['queued', 'running', 'retrying', 'completed', 'failed', 'cancelled']) as status) :: select st.status, count(j.job_id) as n
  from st left join jobs j on j.status = st.status group by st.status
""")
def jobs_by_status_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.status_counts(jobs(spark, sf_dir), "status", [*ops.JOB_STATUSES, "cancelled"])


@query("""
select scan, count(*) filter (where status = 'queued') as queued, count(*) filter (where status = 'running') as running, count(*) filter (where status
  = 'retrying') as retrying, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed from jobs
  group by scan
""")
def jobs_by_scan_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pivot_counts(jobs(spark, sf_dir), "scan", "status", ops.JOB_STATUSES)


@query("""
select path, job_id, status from (select *, row_number() over (partition by path order by made_at desc, job_id desc) as p from jobs) where p = 1
""")
def latest_job_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest(jobs(spark, sf_dir).select("path", "job_id", "status", "made_at"), ["path"], ["made_at", "job_id"]).select("path", "job_id", "status")


@query("""
with last as (select * from (select *, row_number() over (partition by path order by made_at desc, job_id desc) as p from jobs) where p = 1) :: select
  count(*) as total, count(*) filter (where status = 'queued') + count(*) filter (where status = 'retrying') + count(*) filter (where status =
  'running') as pending, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed, cast(sum(k)
  as bigint) as items from last
""")
def job_facts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = merge.latest(jobs(spark, sf_dir).select("path", "job_id", "status", "made_at", "k"), ["path"], ["made_at", "job_id"])
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return last.agg(F.count("*").alias("total"), is_("queued", "retrying", "running").alias("pending"), is_("completed").alias("completed"), is_("failed").alias("failed"), F.sum("k").alias("items"))


@query("select scan, cast(sum(k) as bigint) as items, count(k) as with_items from jobs where status = 'completed' group by scan")
def scan_result_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter("status = 'completed'").groupBy("scan").agg(F.sum("k").alias("items"), F.count("k").alias("with_items"))


_REASON = "case when trim(regexp_replace(regexp_replace(reason, '\\b[0-9]+\\b', ' ', 'g'), '\\s+', ' ', 'g')) = '' then 'unknown failure' else lower(trim(regexp_replace(regexp_replace(reason, '\\b[0-9]+\\b', ' ', 'g'), '\\s+', ' ', 'g'))) end"
_KEY = f"substr(sha256(source_id || chr(0) || stage || chr(0) || {_REASON}), 1, 16)"


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = textfns.failure_reason(F.col("reason"))
    return jobs(spark, sf_dir).filter("status in ('failed', 'retrying')").withColumn("failure", textfns.failure_key(F.col("source_id"), F.col("stage"), reason))


@query(f"""
with f as (select *, {_KEY} as failure from jobs where status in ('failed', 'retrying')), d as (select *, row_number() over (partition by failure
  order by job_id) as place from f) :: select failure, count(*) as n, min(made_at) as first_at, max(made_at) as last_at, max(attempts) as
  max_attempts, string_agg(cast(job_id as varchar), ',' order by job_id) filter (where place <= 5) as ids from d group by failure
""")
def failure_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.failures(_failed(spark, sf_dir), ["failure"], id_col="job_id")


@query(f"""
with f as (select *, {_KEY} as failure from jobs where status in ('failed', 'retrying')) :: select failure, count(*) as n from f group by failure
  having count(*) > 2
""")
def repeated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(spark, sf_dir).groupBy("failure").agg(F.count("*").alias("n")).filter("n > 2")


@query("""
select source_id, job_id, cast(merged as bigint) as merged from (select source_id, job_id, count(*) over (partition by source_id) - 1 as merged,
  row_number() over (partition by source_id order by made_at, job_id) as p from jobs where status = 'failed') where p = 1
""")
def failed_items_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).filter("status = 'failed'").select("source_id", "job_id", "made_at")
    return ops.collapse(rows, "source_id", ["made_at", "job_id"]).select("source_id", "job_id", "merged")


RULES = [(["unauthorized", "401", "login"], "credentials"), (["disk full", "no space"], "storage")]


@query("""
select job_id, case when retryable then 'system' when contains(lower(reason), 'unauthorized') or contains(lower(reason), '401') or
  contains(lower(reason), 'login') then 'owner:credentials' when contains(lower(reason), 'disk full') or contains(lower(reason), 'no space') then
  'owner:storage' else 'system' end as actor from jobs where status = 'failed'
""")
def owner_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter("status = 'failed'").select("job_id", ops.owner_routing(F.col("reason"), F.col("retryable"), RULES).alias("actor"))


@query("""
with c as (select count(*) as n, count(*) filter (where status <> 'queued') as s1, count(*) filter (where status in ('completed', 'failed')) as s2,
  count(*) filter (where status = 'completed') as s3 from jobs), u as (select 'started' as step, s1 as done, n from c union all select 'finished', s2,
  n from c union all select 'kept', s3, n from c) :: select step, done, cast(greatest(0, least(100, round_even(done * 100.0::double / n, 0))) as int)
  as percent from u
""")
def pipeline_steps_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    one = jobs(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(s != "queued").alias("started"), F.count_if(s.isin("completed", "failed")).alias("finished"), F.count_if(s == "completed").alias("kept"))
    long = one.unpivot("n", ["started", "finished", "kept"], "step", "done")
    return long.select("step", "done", percent(F.col("done"), F.col("n")).alias("percent"))


@query("select job_id from jobs where status in ('queued', 'retrying') order by priority, made_at, job_id limit 50")
def queue_due_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter("status in ('queued', 'retrying')").orderBy("priority", "made_at", "job_id").limit(50).select("job_id")


@query("select job_id from jobs, (select max(made_at) as now from jobs) where status = 'running' and made_at <= now - 86400000000")
def stale_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    now = rows.agg(F.max("made_at").alias("now"))
    return rows.filter("status = 'running'").crossJoin(F.broadcast(now)).filter(F.col("made_at") <= F.col("now") - 86_400_000_000).select("job_id")


@query("select job_id, cast(least(3600, 60 * pow(2, attempts - 1)) as bigint) as wait from jobs where status = 'retrying'")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter("status = 'retrying'").select("job_id", backoff_seconds(F.col("attempts")).alias("wait"))


@query("""
select source_id, job_id from (select source_id, job_id, row_number() over (partition by source_id order by made_at desc, job_id desc) as p from jobs)
  where p <= 5
""")
def keep_newest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.newest(jobs(spark, sf_dir).select("source_id", "job_id", "made_at"), ["source_id"], [F.desc("made_at"), F.desc("job_id")], 5).select("source_id", "job_id")


@query("select job_id from jobs, (select max(job_id) as m from jobs) where job_id > m - 500")
def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).select("job_id")
    return rows.crossJoin(F.broadcast(rows.agg(F.max("job_id").alias("m")))).filter("job_id > m - 500").select("job_id")


@query("""
with w as (select doc_id, sum(n_chars) over (order by doc_id rows unbounded preceding) - n_chars as before, sum(n_chars) over () as total from
  documents) :: select doc_id from w where total - before > 1000000
""")
def storage_cap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return merge.evict(docs, F.col("doc_id"), ["doc_id"], "n_chars", 1_000_000).select("doc_id")


@query("""
with r as (select doc_id, n_chars, row_number() over (partition by n_chars >= 1000 order by doc_id desc) as p from documents where doc_id % 7 <> 0), e
  as (select doc_id, n_chars from r where p > 100), w as (select doc_id, sum(n_chars) over (order by doc_id rows unbounded preceding) - n_chars as
  before from e) :: select doc_id from w where before < 200000
""")
def raw_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest first until enough is freed; protected ids and the newest of each size class stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    protected = docs.filter("doc_id % 7 = 0").select("doc_id")
    free = docs.join(protected, "doc_id", "left_anti")
    newest = [free.filter(c).orderBy(F.desc("doc_id")).limit(100) for c in ("n_chars >= 1000", "n_chars < 1000")]
    kept = F.broadcast(newest[0].union(newest[1]).select("doc_id"))  # 200 rows
    eligible = free.join(kept, "doc_id", "left_anti")
    return merge.running_total(eligible, F.col("doc_id"), ["doc_id"], "n_chars").filter("before < 200000").select("doc_id")


@query("""
select user_id, min(epoch_us(ts)) as started, max(epoch_us(ts)) as last_at, count(*) as n, arg_min(event_type, struct_pack(a := ts, b := event_id)) as
  first_type, arg_max(event_type, struct_pack(a := ts, b := event_id)) as last_type from events group by user_id
""")
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = micros(F.col("ts"))
    order = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.min(at).alias("started"), F.max(at).alias("last_at"), F.count("*").alias("n"), F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"))


@query("""
select path, status, attempts from (select path, status, attempts, row_number() over (partition by path order by made_at desc, attempts desc, job_id
  desc) as p from jobs) where p = 1
""")
def late_event_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest(jobs(spark, sf_dir).select("path", "status", "attempts", "made_at", "job_id"), ["path"], ["made_at", "attempts", "job_id"]).select("path", "status", "attempts")


@query("select job_id, status from jobs where job_id > 500 order by job_id limit 101")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row more than the page shows whether there is another."""
    return jobs(spark, sf_dir).filter("job_id > 500").orderBy("job_id").limit(101).select("job_id", "status")


@query("""
select stage as action, count(*) as n, count(*) filter (where attempts >= 4) as high from (select * from jobs order by job_id desc limit 1000) group
  by stage
""")
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = jobs(spark, sf_dir).orderBy(F.desc("job_id")).limit(1000)
    return last.groupBy(F.col("stage").alias("action")).agg(F.count("*").alias("n"), F.count_if(F.col("attempts") >= 4).alias("high"))


@query("""
with o as (select event_id, user_id, md5(cast(event_id as varchar)) as own, lag(md5(cast(event_id as varchar))) over (partition by user_id order by
  event_id) as prev from events), s as (select *, case when event_id % 97 = 0 then 'broken' else prev end as stored from o) :: select event_id from s
  where stored is distinct from prev
""")
def hash_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("own"))
    before = F.lag("own").over(Window.partitionBy("user_id").orderBy("event_id"))
    stored = e.withColumn("stored", F.when(F.col("event_id") % 97 == 0, "broken").otherwise(before))
    return ops.hash_chain_breaks(stored, ["user_id"], ["event_id"], "own", "stored").select("event_id")


# conversations


@query("select conversation_id, count(*) as turns, cast(sum(length(content)) as bigint) as chars from messages group by conversation_id")
def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("turns"), F.sum(F.length("content")).cast("bigint").alias("chars"))


@query("""
with g as (select conversation_id, count(*) as turns, cast(sum(length(content)) as bigint) as chars, bool_or(regexp_matches(content, 'heed|[0-9]{4}'))
  as signal from messages where content <> '' group by conversation_id) :: select *, not (turns < 4 and chars < 900 and not signal) as approved from g
""")
def value_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.value_gate(messages(spark, sf_dir), "conversation_id", "content", 4, 900, "heed|[0-9]{4}")


@query("""
with p as (
  select conversation_id, sequence // 1000 as part,
    sha256(string_agg(sha256(role || ':' || content), '' order by sequence)) as h
  from messages group by 1, 2
) :: select conversation_id, sha256(string_agg(h, '' order by part)) as digest from p group by conversation_id
""")
def conversation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of digests: of each message, then of each thousand of them in order, then of the conversation.

    So what meets in one row is a bounded number of digests and never the texts of a conversation.
    """
    line = F.sha2(F.concat_ws(":", "role", "content").cast("binary"), 256)

    def joined(order: str, value):
        listed = F.array_sort(F.collect_list(F.struct(order, value.alias("_h"))))
        return F.sha2(F.array_join(F.transform(listed, lambda x: x["_h"]), "").cast("binary"), 256)

    parts = messages(spark, sf_dir).groupBy("conversation_id", F.floor(F.col("sequence") / 1000).alias("part")).agg(joined("sequence", line).alias("h"))
    return parts.groupBy("conversation_id").agg(joined("part", F.col("h")).alias("digest"))


@query("""
with c as (select conversation_id, count(*) as n from messages group by conversation_id),
d as (select conversation_id, count(*) as n_at from messages where role <> 'system' group by conversation_id) ::
select c.conversation_id, c.n from c left join d using (conversation_id) where d.conversation_id is null or d.n_at <> c.n
""")
def pending_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that were never distilled, or have other messages now than then (here: all but those of the system)."""
    m = messages(spark, sf_dir)
    c = m.groupBy("conversation_id").agg(F.count("*").alias("n"))
    d = m.filter("role <> 'system'").groupBy("conversation_id").agg(F.count("*").alias("n_at"))
    return c.join(d, "conversation_id", "left").filter("n_at is null or n_at <> n").select("conversation_id", "n")


@query("""
select conversation_id, count(*) as n, min(sequence) = 0 and max(sequence) = count(*) - 1 and count(distinct sequence) = count(*) as contiguous from
  messages group by conversation_id
""")
def ordinal_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.contiguity(messages(spark, sf_dir), "conversation_id", "sequence")


@query("select count(*) as n_rows, count(distinct message_id) as ids, count(distinct sha256(content)) as hashes from messages")
def identity_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_distinct("message_id").alias("ids"), F.count_distinct(F.sha2(F.col("content").cast("binary"), 256)).alias("hashes"))


@query("""
with r as (
  select message_id, message_id as ref from messages union select message_id, cast(conversation_id as varchar) from messages
  union select message_id, conversation_id || '/' || sequence from messages union select message_id, source_id || ':' || role || sequence from messages
) :: select ref, case when count(*) = 1 then min(message_id) end as message_id, case when count(*) = 1 then 'resolved' else 'ambiguous' end as outcome from r group by ref
""")
def ref_resolution_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by id, by conversation, by path and by source and turn: each way is an equi-join key of its own, of all messages."""
    m = messages(spark, sf_dir).withColumn("c", F.col("conversation_id").cast("string")).withColumn("s", F.col("sequence").cast("string"))
    keys = [F.col("message_id"), F.col("c"), F.concat("c", F.lit("/"), "s"), F.concat("source_id", F.lit(":"), "role", "s")]
    return ops.unique_resolution([m.select(k.alias("ref"), "message_id") for k in keys], "ref", "message_id")


@query("""
select j.job_id from jobs j where not exists (select 1 from messages m where m.conversation_id = j.job_id) and not exists (select 1 from memories d
  where d.title = 'src' || cast(j.job_id % 40 as varchar))
""")
def retired_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select("job_id", F.concat(F.lit("src"), F.col("job_id") % 40).alias("title"))
    return j.join(messages(spark, sf_dir).select(F.col("conversation_id").alias("job_id")), "job_id", "left_anti").join(memories(spark, sf_dir).select("title"), "title", "left_anti").select("job_id")


@query("select vec_id from embeddings where vec_id not in (select doc_id from documents where doc_id % 3 <> 0)")
def vector_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("vec_id"))
    return merge.missing(table(spark, sf_dir, "embeddings").select("vec_id"), docs, "vec_id")


@query("""
select count(*) as expected, count(v.vec_id) as indexed, count(*) - count(v.vec_id) as missing, round(count(v.vec_id)::double / count(*), 6) as ratio
  from documents d left join embeddings v on v.vec_id = d.doc_id
""")
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coverage(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""
with v as (select vec_id, embedding, label from embeddings union all select vec_id + 1000000, embedding, label + vec_id % 2 from embeddings where vec_id % 5 = 0),
r as (select vec_id, label, list_transform(embedding, lambda x: round(x::double, 6) + 0.0) as k from v) ::
select min(vec_id) as first_id, count(*) as n, count(distinct label) as labels from r group by k having count(distinct label) > 1
""")
def vector_degenerate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that agree in all values after rounding to six places while what they stand for differs.

    A fifth of the vectors is stored a second time, half of them for other contents.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    again = e.filter("vec_id % 5 = 0").select(F.col("vec_id") + 1_000_000, "embedding", F.col("label") + F.col("vec_id") % 2)
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 6) + 0.0)
    groups = e.union(again).groupBy(rounded.alias("k")).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.count_distinct("label").alias("labels"))
    return groups.filter("labels > 1").select("first_id", "n", "labels")


# documents: merges and duplicates


@query("select memory_id from memories where memory_type = 'decision' and not exists (select 1 from messages m where m.conversation_id = memory_id)")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter("memory_type = 'decision'").join(messages(spark, sf_dir).select(F.col("conversation_id").alias("memory_id")), "memory_id", "left_anti").select("memory_id")


_SIDES = """
e as (
  select title || '/' || heading || '/' || memory_type || '/' || importance as identity, max(memory_id) as version, max(title) as title,
    max(status) as status, count(*) > 2 as gated, bool_or(memory_id % 37 = 0) as emptied
  from memories where review = 'approved' group by 1
), a as (
  select title || '/' || heading || '/' || memory_type || '/' || importance as identity, max(memory_id) as version, max(title) as title, max(status) as status
  from memories where privacy = 'private' group by 1
), s as (
  select coalesce(e.identity, a.identity) as identity, e.version as new_version, a.version as old_version, e.title as new_title, a.title as old_title,
  case when e.identity is null then 'archive:identity_removed'
    when emptied then case when a.identity is not null then 'archive:content_cleared' else 'ignore' end
    when not gated then case when a.identity is not null then 'archive:value_gate' else 'ignore' end
    when a.identity is null then 'add' when e.version <> a.version then 'supersede'
    when e.title <> a.title or e.status <> a.status then 'repair' else 'unchanged' end as action
  from e full join a on a.identity = e.identity
)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the sources say (approved rows) and what is stored (private rows), each by identity; both come from the whole table."""
    rows = memories(spark, sf_dir).withColumn("identity", F.concat_ws("/", "title", "heading", "memory_type", "importance"))
    same = [F.max("memory_id").alias("version"), F.max("title").alias("title"), F.max("status").alias("status")]
    gates = [(F.count("*") > 2).alias("gated"), F.bool_or(F.col("memory_id") % 37 == 0).alias("emptied")]
    return rows.filter("review = 'approved'").groupBy("identity").agg(*same, *gates), rows.filter("privacy = 'private'").groupBy("identity").agg(*same)


@query(f"with {_SIDES} :: select identity, action from s")
def evidence_sync_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.classify_sync(*_sides(spark, sf_dir))


@query(f"""
with {_SIDES}, n as (
  select identity, new_version as version, new_title as title, 'active' as state, cast(null as varchar) as reason from s where action in ('add', 'supersede', 'repair')
  union all select identity, old_version, old_title, 'superseded', 'new_version' from s where action = 'supersede'
  union all select identity, old_version, old_title, 'active', null from s where action = 'unchanged'
  union all select identity, old_version, old_title, 'archived', substr(action, 9) from s where action like 'archive:%'
) :: select identity, version, title, state, reason from n
""")
def evidence_sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after the sync: new versions, closed ones, repaired and archived ones."""
    return merge.apply_sync(*_sides(spark, sf_dir)).select("identity", "version", "title", "state", "reason")


@query(f"""
with {_SIDES} :: select count(*) filter (where action = 'add') as added, 2 * count(*) filter (where action = 'supersede') + count(*) filter (where action = 'repair') as updated,
count(*) filter (where action like 'archive:%') as removed, count(*) filter (where action = 'unchanged') as unchanged from s
""")
def evidence_sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A superseding counts twice among the updated: the closed version and the new one."""
    a = merge.classify_sync(*_sides(spark, sf_dir)).select("action")
    is_ = lambda x: F.count_if(F.col("action") == x)
    return a.agg(is_("add").alias("added"), (2 * is_("supersede") + is_("repair")).alias("updated"), F.count_if(F.startswith("action", F.lit("archive:"))).alias("removed"), is_("unchanged").alias("unchanged"))


@query("""
select memory_id, cast(row_number() over (partition by title order by importance, memory_id) as int) as version, lead(memory_id) over (partition by
  title order by importance, memory_id) as valid_to, case when lead(memory_id) over (partition by title order by importance, memory_id) is null then
  'active' else 'superseded' end as state from memories
""")
def scd2_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("memory_id", "title", "importance")
    return merge.close_versions(rows, "title", ["importance", "memory_id"], "memory_id").select("memory_id", "version", "valid_to", "state")


@query("""
select coalesce(n.k, o.k) as k, coalesce(o.created, n.created) as created, case when n.k is not null then n.title else o.title end as title from
  (select memory_id as k, memory_id as created, title from memories where memory_id % 2 = 0) o full join (select memory_id as k, memory_id + 1000 as
  created, tags as title from memories where memory_id % 3 = 0) n on n.k = o.k
""")
def upsert_keeps_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    old = rows.filter("memory_id % 2 = 0").select(F.col("memory_id").alias("k"), F.col("memory_id").alias("created"), "title")
    new = rows.filter("memory_id % 3 = 0").select(F.col("memory_id").alias("k"), (F.col("memory_id") + 1000).alias("created"), F.col("tags").alias("title"))
    return merge.upsert(old, new, ["k"], keep_first=("created",))


@query("""
select n_nationkey, case when n_nationkey % 3 = 0 then 'own' else r_name end as privacy, n_nationkey % 3 <> 0 as privacy_inherited from nation join
  region on r_regionkey = n_regionkey
""")
def inherited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, "own").alias("privacy"))
    parent = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("parent"), F.col("r_name").alias("privacy"))
    return merge.inherit(child, parent, "parent", "privacy").select("n_nationkey", "privacy", "privacy_inherited")


@query("""
select c_custkey, case when c_custkey % 5 = 0 then 'given' when c_custkey % 3 = 0 then 'stored' || c_custkey % 2 else n_name end as privacy,
  case when c_custkey % 5 = 0 then false when c_custkey % 3 = 0 then c_custkey % 2 = 1 else true end as privacy_inherited from customer join nation on n_nationkey = c_nationkey
""")
def inherited_after_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given value, else the stored one with its flag, else the parent's."""
    key = F.col("c_custkey")
    child = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("parent"), F.when(key % 5 == 0, "given").alias("privacy"))
    stored = table(spark, sf_dir, "customer").filter(key % 3 == 0).select("c_custkey", F.concat(F.lit("stored"), key % 2).alias("privacy"), (key % 2 == 1).alias("privacy_inherited"))
    parent = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("parent"), F.col("n_name").alias("privacy"))
    return merge.inherit(child, parent, "parent", "privacy", stored, "c_custkey").select("c_custkey", "privacy", "privacy_inherited")


@query("select min(doc_id) as first_id, count(*) as n from documents where text is not null group by sha256(text) having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("first_id", "n")


@query("""
select min(doc_id) as first_id, count(*) as n from documents group by trim(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))),
  '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) having count(*) > 1
""")
def dup_normalised_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(textfns.content_hash(F.col("text"))).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("first_id", "n")


@query("""
select a.memory_id, min(b.memory_id) as other from memories a join memories b on a.title = b.title and a.memory_type = b.memory_type and a.tier <>
  b.tier group by a.memory_id
""")
def title_conflict_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least id of the same title and type in another tier.

    One row for each tier of a group is enough to tell, so no pairs within a group are made.
    """
    rows = memories(spark, sf_dir).select("memory_id", "title", "memory_type", "tier")
    least = rows.groupBy("title", "memory_type", "tier").agg(F.min("memory_id").alias("id"))
    known = least.groupBy("title", "memory_type").agg(F.collect_list(F.struct("tier", "id")).alias("known"))
    other = F.array_min(F.transform(F.filter("known", lambda x: x.tier != F.col("tier")), lambda x: x.id))
    return rows.join(known, ["title", "memory_type"]).select("memory_id", other.alias("other")).filter("other is not null")


@query("""
select count(*) as documents, count(*) filter (where text is null or trim(text) = '') as emptied, count(distinct doc_id) as ids, (select count(*) from
  labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)) as orphan_labels from documents
""")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = d.agg(F.count("*").alias("documents"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("emptied"), F.count_distinct("doc_id").alias("ids"))
    return one.crossJoin(F.broadcast(lab.join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphan_labels"))))


# review and evaluation


@query("""
select doc_id, cast(least(100, pts) as int) as score, case when pts >= 90 then 'critical' when pts >= 60 then 'high' when pts >= 25 then 'medium' else
  'low' end as level from (select doc_id, toxic * 75 + (1 - quality) * 30 + 5 as pts from labels)
""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, level = ops.capped_risk(F.array(F.col("toxic") * 75, (1 - F.col("quality")) * 30, F.lit(5)))
    return table(spark, sf_dir, "labels").select("doc_id", score.alias("score"), level.alias("level"))


#: Names of findings (fixed values).
_FINDINGS = ["schema_invalid", "core_memory_requires_owner", "restricted_content_requires_owner", "insufficient_evidence_requires_owner"]


def _findings(rows: DataFrame) -> DataFrame:
    tests = [F.trim("text") == "", F.col("tier") == "core", F.col("privacy") == "restricted", (F.col("memory_type") != "preference") & (F.col("importance") < 2)]
    listed = F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in zip(tests, _FINDINGS, strict=True)]), lambda x: x.isNotNull())
    return rows.withColumn("findings", listed)


_FOUND = "concat_ws(',', case when trim(text) = '' then 'schema_invalid' end, case when tier = 'core' then 'core_memory_requires_owner' end, case when privacy = 'restricted' then 'restricted_content_requires_owner' end, case when memory_type <> 'preference' and importance < 2 then 'insufficient_evidence_requires_owner' end)"


@query(f"select memory_id, {_FOUND} as findings from memories")
def hard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(memories(spark, sf_dir)).select("memory_id", F.array_join("findings", ",").alias("findings"))


@query(f"""
with f as (select *, {_FOUND} as found from memories) :: select memory_id, case when contains(found, 'schema_invalid') then 'blocked' when found <> ''
  then 'requires_owner_review' when memory_id % 10 = 3 then 'would_append_evidence' when length(text) < 60 then 'would_auto_reject_noise' when
  importance >= 3 then 'would_auto_approve' else 'requires_owner_review' end as action from f
""")
def review_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(memories(spark, sf_dir))
    action = (
        F.when(F.array_contains("findings", "schema_invalid"), "blocked").when(F.size("findings") > 0, "requires_owner_review").when(F.col("memory_id") % 10 == 3, "would_append_evidence")
        .when(F.length("text") < 60, "would_auto_reject_noise").when(F.col("importance") >= 3, "would_auto_approve").otherwise("requires_owner_review")
    )
    return rows.select("memory_id", action.alias("action"))


@query("""
select memory_id, round(weight * 0.35::double + (case tier when 'core' then 0.3 when 'pinned' then 0.2 else 0.1 end)::double * 0.25::double +
  greatest(0, 1 - (importance - 1) * 0.15::double) * 0.15::double + (case when importance <= 2 then 0.85 when importance <= 3 then 0.65 else 0.35
  end)::double * 0.25::double, 4) as score from memories
""")
def decision_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = F.when(F.col("tier") == "core", "fast").when(F.col("tier") == "pinned", "mid").otherwise("slow")
    return memories(spark, sf_dir).select("memory_id", ops.decision_score(F.col("weight"), speed, F.col("importance")).alias("score"))


@query("""
with x as (select item_id, text, item_id % 10 as g from benchmark union all select item_id + 1000000, substr(text, 4, 25), item_id % 10 from benchmark),
f as (select x.item_id, g, count(d.doc_id) as hits from x left join documents d on contains(d.text, x.text) group by x.item_id, g) ::
select g, count(*) as expected, count(*) filter (where hits > 0) as found, round(count(*) filter (where hits > 0)::double / count(*), 6) as recall from f group by g
""")
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expected passages, and pieces of them that start and end within words, are found, and the recall of each group."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"), (F.col("item_id") % 10).alias("g"))
    items = items.union(items.select(F.col("item_id") + 1_000_000, F.substring("passage", 4, 25), "g"))
    found = ops.contained_passages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), items, "item_id", "passage").select("item_id").distinct()
    both = items.join(found.withColumn("hit", F.lit(1)), "item_id", "left")
    return both.groupBy("g").agg(F.count("*").alias("expected"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("expected"), 6))


@query("""
with m as (select avg(quality::double) as recall, avg(toxic::double) as pollution, count(*) as n from labels) :: select case when recall < 0.5 or
  pollution > 0.5 then 'FAIL' when n < 100 then 'BLOCKED' else 'PASS' end as verdict from m
""")
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measured failure comes before a missing measurement."""
    m = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("recall"), F.avg("toxic").alias("pollution"), F.count("*").alias("n"))
    return m.select(F.when((F.col("recall") < 0.5) | (F.col("pollution") > 0.5), "FAIL").when(F.col("n") < 100, "BLOCKED").otherwise("PASS").alias("verdict"))


@query("""
select n_chars as value from (select n_chars, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents) where i =
  cast(floor(n * 0.95::double) as bigint)
""")
def percentile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.indexed_percentile(table(spark, sf_dir, "documents"), "n_chars", 0.95)


@query("""
with o as (select item_id, row_number() over (order by item_id) as i from benchmark), d as (select doc_id, row_number() over (order by doc_id) as i
  from labels) :: select count(*) as positions, count(*) filter (where o.i is null) as extra, count(*) filter (where d.i is null) as missing, count(*)
  filter (where o.item_id = d.doc_id) as same from o full join d on d.i = o.i
""")
def import_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and stored rows compared by position; positions come from a partitioned count, not one global window."""
    def placed(df: DataFrame, key: str, name: str) -> DataFrame:
        return merge.running_total(df.select(F.col(key).alias(name)).withColumn("_one", F.lit(1)), F.col(name), [name], "_one", "i").drop("_one")

    o, d = placed(table(spark, sf_dir, "benchmark"), "item_id", "o"), placed(table(spark, sf_dir, "labels"), "doc_id", "d")
    return o.join(d, "i", "full_outer").agg(F.count("*").alias("positions"), F.count_if(F.col("o").isNull()).alias("extra"), F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("o") == F.col("d")).alias("same"))


@query("""
with f as (select conflict_key, min(memory_id) as first_at from memories where conflict_key <> '' group by conflict_key order by first_at limit 4) ::
  select m.memory_id, m.conflict_key from memories m join f using (conflict_key) where m.tier = 'core'
""")
def select_facts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the first four distinct facts, in the order in which facts first occur."""
    rows = memories(spark, sf_dir).filter("conflict_key <> ''")
    first = rows.groupBy("conflict_key").agg(F.min("memory_id").alias("first_at")).orderBy("first_at").limit(4)
    return rows.join(F.broadcast(first), "conflict_key").filter("tier = 'core'").select("memory_id", "conflict_key")


@query("""
with p as (
  select project, list(memory_id order by memory_id) filter (where tier <> 'normal') as a, list(memory_id order by authority, memory_id) filter (where tier <> 'normal') as b,
    list(memory_id order by memory_id) filter (where tier = 'core' or review = 'approved' and tier = 'pinned') as c from memories group by project
) :: select project, case when a = b then 'equal' when len(a) <> len(b) then 'length' else 'order' end as by_order,
case when a = c then 'equal' when len(a) <> len(c) then 'length' else 'order' end as by_rule from p
""")
def pack_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two packs hold the same identities in the same order; packs are told by a digest of ranges, not by their lists."""
    rows = memories(spark, sf_dir).filter("tier <> 'normal'").select("project", "memory_id", "authority", ((F.col("tier") == "core") | (F.col("review") == "approved")).alias("also"))
    return ops.pack_parity(rows, "project", "memory_id", "authority", "also")


# text and sources


#: Kinds whose patterns need no lookaround, which the oracle's engine lacks.
_PLAIN_KINDS = [(k, p) for k, _, p in textfns.PRIVACY_PATTERNS if "(?<" not in p and "(?!" not in p]


def _hits_sql(kind: str, pattern: str) -> str:
    text = pattern.replace("'", "''")
    return f"cast(len(regexp_extract_all(text, '{text}')) as int) as {kind}"


@query(f"select doc_id, {', '.join(_hits_sql(*x) for x in _PLAIN_KINDS)} from documents")
def privacy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = textfns.privacy_counts(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(counts[k].alias(k) for k, _ in _PLAIN_KINDS))


@query()
def privacy_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten patterns; two need lookarounds, which the oracle's engine lacks. Texts without a hit are not rewritten."""
    text = F.coalesce("text", F.lit(""))
    hit = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("hit", textfns.privacy_hits(text))
    return hit.select("doc_id", F.when(F.col("hit"), textfns.privacy_class(text)).otherwise("private").alias("privacy"), F.when(F.col("hit"), textfns.redact(text)).otherwise(text).alias("redacted"))


@query("""
with u as (select page_id, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?', ['s', 'h', 'p', 'q']) as u from pages),
k as (select page_id, u, rtrim(u.p, '/') as path, array_to_string(list_sort(list_filter(string_split(u.q, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid'))), '&') as q from u)
:: select page_id, lower(u.s) || '://' || lower(u.h) || case when path = '' then '/' else path end || case when q = '' then '' else '?' || q end as url from k
""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", textfns.normalise_url(F.col("url")).alias("url"))


@query("select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title, cast(len(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1))) as int) as links from pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", history.page_title(html).alias("title"), F.size(history.page_links(html)).alias("links"))


_TAGS = "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "noscript", "template", "svg"))
_HTML_TEXT = (
    f"regexp_replace(regexp_replace(regexp_replace(html, '(?is){_TAGS}|<!--.*?-->|<head\\b.*?</head\\s*>', ' ', 'g'), "
    "'(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote|pre)\\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
)
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML_TEXT = f"replace({_HTML_TEXT}, '{_name}', '{_sign}')"


@query(f"""
with t as (select page_id, html, regexp_replace(regexp_replace(regexp_replace({_HTML_TEXT}, '[ \\t\\x{{00A0}}]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g') as text from pages)
:: select page_id, text, case when length(text) >= 500 then 'content' when html <> '' then 'partial' else 'metadata_only' end as completeness from t
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html", history.page_text(F.col("html")).alias("text"))
    return pages.select("page_id", "text", textfns.completeness(F.col("text"), F.lit(""), F.col("html")).alias("completeness"))


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("select doc_id, substr(replace(text, chr(10), ' '), 1, 200) as preview, cast(length(text) as int) as n from documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", textfns.preview(F.col("text")).alias("preview"), F.length("text").alias("n"))


@query("""
select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars, min(n_chars) as shortest, max(n_chars) as longest from documents group by lang
""")
def storage_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
