"""Audits, gates, diagnostics, evidence chains, retention with floors, and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import rules, values
from palimpsest.functions.textfns import completeness
from palimpsest.operators import merge, search
from palimpsest.plans.registry import query
from palimpsest.plans.tables import jobs, memories, messages, spread, table
from palimpsest.sources import chunking, history

# evidence


@query("""
with s as (select 's' || k as source_id, case when k = 3 then 'revoked' else 'active' end as status, case when k = 4 then 'restricted' else 'private' end as privacy from (select unnest(range(0, 5)) as k)),
l as (select memory_id, memory_id % 100 as conversation_id, importance as sequence from memories where status = 'active' and lower(project) = 'p3') ::
select l.memory_id, m.message_id, case when sh.status = 'active' then m.content else '' end as content from l join messages m using (conversation_id, sequence) join s sh on sh.source_id = m.source_id
  join (select conversation_id, count(*) as n from messages group by conversation_id) c using (conversation_id) where sh.privacy = 'private' and (m.conversation_id % 4 = 0 or m.conversation_id % 4 <> 2)
""")
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link, message, source and conversation, each of which the viewer must see; texts only while the source is active.

    The project of linked evidence is matched exactly but for case; scopes of a conversation let pass the viewer and all.
    """
    source = spark.createDataFrame([(f"s{k}", "revoked" if k == 3 else "active", "restricted" if k == 4 else "private") for k in range(5)], "source_id string, state string, class string")
    m = messages(spark, sf_dir)
    kind = F.col("conversation_id") % 4
    scopes = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array(F.lit("all"))).when(kind == 2, F.array(F.lit("a1"))).otherwise(F.array(F.lit("a2"), F.lit("all")))
    conv = m.select("conversation_id").distinct().withColumn("scopes", scopes).filter(search.scope_visible(F.col("scopes"), "a2"))
    links = memories(spark, sf_dir).filter((F.col("status") == "active") & (F.lower("project") == "p3")).select("memory_id", (F.col("memory_id") % 100).alias("conversation_id"), F.col("importance").cast("bigint").alias("sequence"))
    seen = links.join(m, ["conversation_id", "sequence"]).join(F.broadcast(source.filter("class = 'private'")), "source_id").join(conv, "conversation_id", "left_semi")
    return seen.select("memory_id", "message_id", F.when(F.col("state") == "active", F.col("content")).otherwise("").alias("content"))


@query("""
select memory_id from memories where privacy in ('private') and memory_type = 'preference' and status = 'active' and project = 'p4' and (scope = '' or scope like '%all%') and (title ilike '%SRC1%' or heading ilike '%src1%' or tags ilike '%src1%')
order by coalesce(valid_to, valid_from, '') desc, memory_id desc limit 50
""")
def inspector_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter of the inspector at once, newest first."""
    fine = search.in_or_none("privacy", ["private"]) & search.equal_or_any("memory_type", "preference") & search.equal_or_any("status", "active")
    fine = fine & search.json_member("projects", "p4") & search.scope_visible(F.col("scopes"), "all") & search.like_any(["title", "heading", "tags"], "SRC1")
    rows = memories(spark, sf_dir).withColumn("projects", F.to_json(F.array("project"))).filter(fine)
    return search.page(rows, [F.desc(F.coalesce("valid_to", "valid_from", F.lit(""))), F.desc("memory_id")], 50).select("memory_id")


@query("""
select chunk_id, row_number() over (order by title_hit desc, weight desc, moment desc, chunk_id) as place from (select chunk_id, weight, coalesce(valid_from, '') as moment, case when contains(lower(title), 'src3') then 1 else 0 end as title_hit from memories
where contains(lower(title || ' ' || heading || ' ' || text || ' ' || tags), 'src3') order by title_hit desc, weight desc, moment desc, chunk_id limit 30)
""")
def substring_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring search's order: hits in the title, then weight, then time."""
    from pyspark.sql import Window

    rows = search.substring(spread(memories(spark, sf_dir)), ["src3"]).withColumn("moment", F.coalesce("valid_from", F.lit("")))
    order = [F.desc("title_hit"), F.desc("weight"), F.desc("moment"), F.asc("chunk_id")]
    first = rows.select("chunk_id", "title_hit", "weight", "moment").orderBy(*order).limit(30)
    return first.select("chunk_id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


# failures and retention


@query("""
with f as (select *, row_number() over (partition by source_id order by made_at, job_id) as p, count(*) over (partition by source_id) as n, max(made_at) over (partition by source_id) as last from jobs where status = 'failed')
:: select job_id, source_id, case when p = 1 then stage || ' (x' || n || ')' else stage end as title, case when p = 1 then 'failed' else 'merged' end as state, case when p = 1 then last else made_at end as updated from f
""")
def failed_items_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed items of a source: the earliest stands for all, with their number in its title and the latest time; others are merged."""
    f = jobs(spark, sf_dir).filter("status = 'failed'")
    lead = f.groupBy("source_id").agg(F.min(F.struct("made_at", "job_id")).alias("first"), F.count("*").alias("n"), F.max("made_at").alias("last"))
    both = f.join(lead, "source_id").withColumn("is_first", F.col("job_id") == F.col("first.job_id"))
    title = F.when(F.col("is_first"), F.concat("stage", F.lit(" (x"), "n", F.lit(")"))).otherwise(F.col("stage"))
    return both.select("job_id", "source_id", title.alias("title"), F.when(F.col("is_first"), "failed").otherwise("merged").alias("state"), F.when(F.col("is_first"), F.col("last")).otherwise(F.col("made_at")).alias("updated"))


@query("""
with u as (select sum(n_chars) - 800000 as budget from documents), e as (select doc_id, n_chars, n_chars >= 1000 as large from documents),
s as (select doc_id from e where not large order by doc_id desc limit 50), g as (select doc_id from e where large order by doc_id desc limit 3),
f as (select doc_id, n_chars from e where doc_id not in (select doc_id from s) and doc_id not in (select doc_id from g) and doc_id % 11 <> 0 and (select max(doc_id) from documents) - doc_id >= case when large then 60 else 20 end),
w as (select doc_id, sum(n_chars) over (order by doc_id) - n_chars as before from f) :: select doc_id from w, u where before < budget
""")
def raw_eviction_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest first until the target is met; protected ids, the newest small and large ones, and whatever is too young for its
    class stay. Ids stand for times here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").withColumn("large", F.col("n_chars") >= 1000)
    figures = docs.agg((F.sum("n_chars") - 800_000).alias("budget"), F.max("doc_id").alias("now"))
    newest = docs.filter("not large").orderBy(F.desc("doc_id")).limit(50).union(docs.filter("large").orderBy(F.desc("doc_id")).limit(3)).select("doc_id")
    protected = docs.filter("doc_id % 11 = 0").select("doc_id")
    free = docs.join(F.broadcast(newest), "doc_id", "left_anti").join(protected, "doc_id", "left_anti").crossJoin(F.broadcast(figures))
    old = free.filter(F.col("now") - F.col("doc_id") >= F.when(F.col("large"), 60).otherwise(20))
    return merge.running_total(old, F.col("doc_id"), ["doc_id"], "n_chars").filter("before < budget").select("doc_id")


@query("""
select job_id, path || case when job_id % 9 = 0 then chr(7) when job_id % 9 = 1 then '/../x' when job_id % 9 = 2 then '//y' else '' end as p, job_id %
  9 > 2 as fine from jobs
""")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without a root, empty or dot parts, and control characters."""
    i = F.col("job_id") % 9
    p = F.concat("path", F.when(i == 0, "\x07").when(i == 1, "/../x").when(i == 2, "//y").otherwise(""))
    fine = p.rlike(r"^[^/]+(/[^/]+)*$") & ~p.rlike(r"[\x00-\x1f\x7f]") & ~F.exists(F.split(p, "/"), lambda x: x.isin(".", ".."))
    return jobs(spark, sf_dir).select("job_id", p.alias("p"), fine.alias("fine"))


@query("""
select job_id from (select job_id, row_number() over (order by made_at desc, job_id desc) as p from jobs where status = 'completed') where p <= 200
""")
def newest_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two hundred retired ones of all stay."""
    return merge.newest(jobs(spark, sf_dir).filter("status = 'completed'"), None, [F.desc("made_at"), F.desc("job_id")], 200).select("job_id")


@query("""
with n as (select source_id || ':' || k as key, min(job_id) as job_id from jobs where status = 'queued' group by 1) :: select key, job_id from n where
  key not in (select source_id || ':' || k from jobs where status = 'completed' and k is not null)
""")
def idempotent_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job is queued once for its key, and not at all where the key is already known."""
    j = jobs(spark, sf_dir).withColumn("key", F.concat("source_id", F.lit(":"), F.col("k").cast("string")))
    new = j.filter("status = 'queued'").groupBy("key").agg(F.min("job_id").alias("job_id"))
    return merge.record_once(j.filter("status = 'completed'").select("key"), new, "key")


# audits and gates


@query("""
with e as (select row_number() over (order by conversation_id, sequence) - 1 as i, message_id, role, sequence, sha256(content) as h, conversation_id from messages),
a as (select row_number() over (order by conversation_id, sequence) - 1 as i, case when sequence % 7 = 5 then message_id || 'x' else message_id end as message_id, case when sequence % 5 = 4 then 'user' else role end as role,
  sequence, sha256(case when sequence % 6 = 5 then '' else content end) as h, conversation_id, source_id || case when conversation_id % 10 = 0 and sequence > 2 then 'b' else '' end as sid from messages) ::
select count(*) as paired, count(*) filter (where e.message_id = a.message_id) as keys, count(*) filter (where e.role = a.role) as roles, count(*) filter (where e.sequence = a.sequence) as sequences, count(*) filter (where e.h = a.h) as hashes,
  (select count(*) from e x where not exists (select 1 from a y where y.message_id = x.message_id)) as missing, (select count(*) from a y where not exists (select 1 from e x where x.message_id = y.message_id)) as extra,
  (select cast(sum(n - 1) as bigint) from (select count(distinct sid) as n from a group by conversation_id)) as repeated_sources from e join a using (i)
""")
def import_audit_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and stored messages paired by place: how many keys, roles, numbers and hashes agree, which keys are missing or
    extra, and how many records one external source has beyond the first. Places are counted over ranges."""
    m = messages(spark, sf_dir)
    s, sha = F.col("sequence"), lambda c: F.sha2(c.cast("binary"), 256)
    known = [F.col("conversation_id").alias("c"), s]
    expected = m.select(*known, "message_id", "role", sha(F.col("content")).alias("h"))
    sid = F.concat("source_id", F.when((F.col("conversation_id") % 10 == 0) & (s > 2), "b").otherwise(""))
    stored = m.select(*known, F.when(s % 7 == 5, F.concat("message_id", F.lit("x"))).otherwise(F.col("message_id")).alias("message_id"), F.when(s % 5 == 4, "user").otherwise(F.col("role")).alias("role"), sha(F.when(s % 6 == 5, "").otherwise(F.col("content"))).alias("h"), sid.alias("sid"))
    placed = lambda df: merge.running_total(df.withColumn("_one", F.lit(1)), F.col("c"), ["c", "sequence"], "_one", "i").drop("_one")
    e, a = placed(expected).alias("e"), placed(stored).alias("a")
    same = lambda c: F.count_if(F.col(f"e.{c}") == F.col(f"a.{c}"))
    one = e.join(a, F.col("e.i") == F.col("a.i")).agg(F.count("*").alias("paired"), same("message_id").alias("keys"), same("role").alias("roles"), same("sequence").alias("sequences"), same("h").alias("hashes"))
    missing = merge.missing(expected, stored, "message_id").agg(F.count("*").alias("missing"))
    extra = merge.missing(stored, expected, "message_id").agg(F.count("*").alias("extra"))
    repeated = stored.groupBy("c").agg((F.count_distinct("sid") - 1).alias("n")).agg(F.sum("n").alias("repeated_sources"))
    return one.crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(extra)).crossJoin(F.broadcast(repeated))


@query("select row_number() over (order by conv_id, turn) - 1 as ordinal, conv_id || ':' || turn as key from conversations")
def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in order of conversation and turn, with one number over all."""
    from palimpsest.operators import writes

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return writes.numbered(c, F.col("conv_id"), ["conv_id", "turn"]).select("ordinal", F.concat("conv_id", F.lit(":"), "turn").alias("key"))


_FIGURES = """
f as (select cast(lang as varchar) as run, 100 as answered, count(*) as hits, count(*) + count(*) filter (where doc_id % 17 = 0) as total, 96.0 as citations, 97.0 as activation, 99.0 as tools, cast(sum(n_chars) as bigint) as baseline, cast(sum(n_chars) // 20 as bigint) as rendered,
  count(*) filter (where text is null) as leaks, count(*) - count(distinct doc_id) as repeated, lang <> 'es' as reviewed, lang <> 'de' as recovered from documents group by lang)"""


@query(f"""
with {_FIGURES} :: select run, round(100.0 * hits / total, 6) as recall, round((1 - rendered::double / baseline) * 100, 6) as reduction,
case when answered <> 100 or 100.0 * hits / total < 90 or citations < 95 or activation < 95 or tools < 95 or baseline <= 0 or rendered > baseline or (1 - rendered::double / baseline) * 100 < 90 or leaks <> 0 or repeated <> 0 then 'FAIL'
  when not reviewed or not recovered then 'BLOCKED' else 'PASS' end as verdict from f
""")
def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the figures of each run: a measured failure comes before a measurement that is missing."""
    d = table(spark, sf_dir, "documents")
    n = F.count("*")
    f = d.groupBy(F.col("lang").alias("run")).agg(
        F.lit(100).alias("answered"), n.alias("hits"), (n + F.count_if(F.col("doc_id") % 17 == 0)).alias("total"), F.sum("n_chars").alias("baseline"), F.floor(F.sum("n_chars") / 20).alias("rendered"),
        F.count_if(F.col("text").isNull()).alias("leaks"), (n - F.count_distinct("doc_id")).alias("repeated"),
    )
    ok = lambda lang: F.when(F.col("run") != lang, 100.0)
    told = f.withColumns({"citations": F.lit(96.0), "activation": F.lit(97.0), "tools": F.lit(99.0), "reviewed": ok("es"), "recovered": ok("de")})
    verdict, recall, reduction = rules.gate({c: F.col(c) for c in told.columns})
    return told.select("run", F.round(recall, 6).alias("recall"), F.round(reduction, 6).alias("reduction"), verdict.alias("verdict"))


@query("""
with o as (select memory_id, importance <> 2 as same_order, memory_id % 13 = 0 as forbidden, memory_id % 7 = 0 as wrong_citation, memory_id % 5 = 0 as wrong_mode, length(text) > 4000 as long_, memory_id % 19 = 0 as fell_back, memory_id % 23 = 0 as unlike from memories)
:: select memory_id, concat_ws(',', case when not same_order then 'identity_order_mismatch' end, case when forbidden then 'forbidden_evidence' end, case when wrong_citation then 'citation_mismatch' end, case when wrong_mode then 'temporal_mismatch' end,
  case when long_ then 'context_budget_exceeded' end, case when fell_back then 'fallback' end, case when unlike then 'parity_mismatch' end) as failures,
case when wrong_citation then 'provenance' when wrong_mode then 'temporal' when not same_order or forbidden then 'retrieval' when long_ then 'context' when fell_back then 'fallback' when unlike then 'mcp' else '' end as bucket from o
""")
def question_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a question failed, in order, and the first bucket that explains it."""
    i = F.col("memory_id")
    cases = [
        (F.col("importance") == 2, "identity_order_mismatch", "retrieval"), (i % 13 == 0, "forbidden_evidence", "retrieval"), (i % 7 == 0, "citation_mismatch", "provenance"), (i % 5 == 0, "temporal_mismatch", "temporal"),
        (F.length("text") > 4000, "context_budget_exceeded", "context"), (i % 19 == 0, "fallback", "fallback"), (i % 23 == 0, "parity_mismatch", "mcp"),
    ]
    failures, bucket = rules.diagnosis(cases)
    return memories(spark, sf_dir).select("memory_id", F.array_join(failures, ",").alias("failures"), bucket.alias("bucket"))


@query("""
with c as (select *, memory_id % 4 = 1 and title = 'src1' as same_scope, memory_id % 6 = 5 as noise, importance >= 2 as enough, privacy = 'restricted' or tier = 'core' as manual, memory_id % 53 = 0 as off from memories)
:: select memory_id, case when off then 'blocked' when manual then 'requires_owner_review' when same_scope then 'would_append_evidence' when noise then 'would_auto_reject_noise' when enough then 'would_auto_approve' else 'requires_owner_review' end as action from c
""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("memory_id")
    action = rules.review_action(i % 53 == 0, (F.col("privacy") == "restricted") | (F.col("tier") == "core"), (i % 4 == 1) & (F.col("title") == "src1"), i % 6 == 5, F.col("importance") >= 2)
    return memories(spark, sf_dir).select("memory_id", action.alias("action"))


@query("""
select memory_type, count(*) as total, count(*) filter (where review = 'approved') as correct, case when bool_or(status = '') then null else
  round(count(*) filter (where review = 'approved')::double / count(*), 6) end as accuracy from memories group by memory_type
""")
def promotion_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted as expected by category; the ratio is null while an outcome of the category is open."""
    ok = F.count_if(F.col("review") == "approved")
    ratio = F.when(~F.bool_or(F.col("status") == ""), F.round(ok / F.count("*"), 6))
    return memories(spark, sf_dir).groupBy("memory_type").agg(F.count("*").alias("total"), ok.alias("correct"), ratio.alias("accuracy"))


# text


@query("""
select memory_id, '## ' || title || chr(10) || chr(10) || '> memory_id=' || memory_id || ' · lifecycle=' || status || ' · authority=' || authority || chr(10) || chr(10) || substr(replace(text, chr(10), ' '), 1, 80) || chr(10) || chr(10) || '> ' ||
  concat_ws(' · ', heading, nullif(scope, ''), cast(memory_id as varchar), case when weight > 1 then 'L1-L9' end) as section from memories where tier = 'core'
""")
def rendered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as Markdown: heading, facts, text and a citation line without the parts that are missing."""
    facts = F.concat(F.lit("> memory_id="), "memory_id", F.lit(" · lifecycle="), "status", F.lit(" · authority="), "authority")
    cited = F.concat(F.lit("> "), F.concat_ws(" · ", "heading", F.nullif("scope", F.lit("")), F.col("memory_id").cast("string"), F.when(F.col("weight") > 1, "L1-L9")))
    body = F.substring(F.translate("text", "\n", " "), 1, 80)
    return memories(spark, sf_dir).filter("tier = 'core'").select("memory_id", F.concat_ws("\n\n", F.concat(F.lit("## "), "title"), facts, body, cited).alias("section"))


@query("""
select doc_id, cast(ceil(greatest(length(text) - 150, 1) / 1350.0) as int) as chunks from documents where length(text) > 1500 and not contains(text,
  chr(10) || chr(10)) and text = trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) and length(text) % 1350 <> 0 and length(text) % 1350 > 150
""")
def paragraph_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks a text of one long paragraph gives by the plain rule: one every 1,350 characters."""
    n = F.length("text")
    rows = table(spark, sf_dir, "documents").filter((n > 1500) & ~F.contains("text", F.lit("\n\n")) & (F.col("text") == F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))) & (n % 1350 > 150))
    return chunking.paragraph_chunks(spread(rows.select("doc_id", "text"))).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))


@query("""
with n as (select doc_id, '---' || chr(10) || 'id: n' || doc_id || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || 'status: active' || chr(10) || '---' || chr(10) || text as note, text, lang, source from documents)
:: select doc_id, 'n' || doc_id as id, 'active' as status, lang || '|' || source as tags, sha256(text) as body_hash from n
""")
def note_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars and lists of a front matter, and the digest of the body behind it."""
    note = F.concat(F.lit("---\nid: n"), "doc_id", F.lit("\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\nstatus: active\n---\n"), "text")
    rows = table(spark, sf_dir, "documents").select("doc_id", note.alias("note"))
    n = F.col("note")
    tags = F.array_join(history.front_matter_list(n, "tags"), "|")
    return rows.select("doc_id", history.front_matter(n, "id").alias("id"), history.front_matter(n, "status").alias("status"), tags.alias("tags"), F.sha2(history.body(n).cast("binary"), 256).alias("body_hash"))


@query("""
select event_id, case when event_id % 3 = 0 then rtrim(left(event_type || ' ' || event_type || ' long', 9)) || '…' else event_type end as cut,
  lower(event_type) = 'view' as either from events
""")
def snippets_and_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut with an ellipsis, and whether one of two texts holds the other."""
    from palimpsest.functions.textfns import snippet

    t = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" "), "event_type", F.lit(" long"))).otherwise(F.col("event_type"))
    either = values.holds_either(F.col("event_type"), F.lit("a view of it")) & (F.col("event_type") == "view")
    cut = F.when(F.col("event_id") % 3 == 0, snippet(t, 10)).otherwise(t)
    return table(spark, sf_dir, "events").select("event_id", cut.alias("cut"), either.alias("either"))


# gateway, sinks and authority


@query("""
with a as (select memory_id, case when memory_id % 2 = 0 then 's' || (memory_id % 6) else '' end as source_id, tier = 'core' and review = 'approved' as own from memories)
:: select memory_id from a where source_id = '' or own or source_id in ('s0', 's4')
""")
def source_authority_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an automatic source brought are shown while that source is authorised; approved core memories and rows without such a
    source always are."""
    sources = spark.createDataFrame([("s0", "authorized"), ("s2", "revoked"), ("s4", "Authorized ")], "source_id string, status string")
    rows = memories(spark, sf_dir).withColumn("source_id", F.when(F.col("memory_id") % 2 == 0, F.concat(F.lit("s"), F.col("memory_id") % 6)).otherwise(""))
    return search.authorised(rows, sources, "source_id", (F.col("tier") == "core") & (F.col("review") == "approved")).select("memory_id")


@query("select memory_id, valid_from from memories where privacy = 'private' order by valid_from desc nulls last, memory_id desc limit 100")
def gateway_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's limit of 500 is clamped to what a gateway gives, and its privacy classes to those allowed."""
    rows = memories(spark, sf_dir).filter(search.in_or_none("privacy", ["private"]))
    return rows.orderBy(F.desc_nulls_last("valid_from"), F.desc("memory_id")).limit(search.clamped(500, 100)).select("memory_id", "valid_from")


@query("select 'raw/' || substr(sha256(text), 1, 2) || '/' || sha256(text) as path, count(*) as uses, min(doc_id) as first_id from documents where text is not null group by 1")
def raw_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts are kept once each, under the name of their digest."""
    from palimpsest.operators import writes

    return writes.content_addressed(table(spark, sf_dir, "documents").filter("text is not null"), "text", "doc_id")


@query("select message_id, role || ' [REDACTED:email] ' || sequence as content, coalesce(sequence < 2, false) as known from messages")
def structured_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of messages on its way into the read model: flattened, redacted, merged over what is stored."""
    from palimpsest.operators import writes

    m = messages(spark, sf_dir)
    batch = m.select("message_id", F.concat("role", F.lit(" me"), "conversation_id", F.lit("@ex.org "), "sequence").alias("content"), F.lit(False).alias("known"))
    stored = m.filter("sequence < 2").select("message_id", F.lit("old").alias("content"), F.lit(True).alias("known"))
    return writes.sink(stored, batch, "message_id", "content", keep_first=("known",))


@query("""
with p as (select project, count(*) as a, count(*) filter (where tier <> 'core' or memory_id % 2 = 0) as b, cast(sum(length(title)) as bigint) as used_a, cast(sum(length(title)) as bigint) + case when project = 'p2' then 1 else 0 end as used_b, case when project = 'p1' then 10 else 100000000 end as most from memories group by project)
:: select project, case when used_a > most or used_b > most or used_a <> used_b then 'bounds_mismatch' when a = 0 and b = 0 then 'retrieval_empty' when a <> b then 'schema_mismatch' else 'identity_and_bounds_equal' end as reason from p
""")
def pack_parity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why two packs differ; bounds come before contents. Contents are compared by counts and sums of digests, not by lists."""
    digest = F.xxhash64("memory_id").cast("decimal(38,0)")
    in_b = (F.col("tier") != "core") | (F.col("memory_id") % 2 == 0)
    used = F.sum(F.length("title"))
    p = memories(spark, sf_dir).groupBy("project").agg(F.count("*").alias("a"), F.count_if(in_b).alias("b"), F.sum(digest).alias("da"), F.sum(F.when(in_b, digest)).alias("db"), used.alias("used"))
    more = F.when(F.col("project") == "p2", 1).otherwise(0)
    most = F.when(F.col("project") == "p1", 10).otherwise(100_000_000)
    return p.select("project", rules.parity_reason(F.col("used"), F.col("used") + more, most, F.col("a"), F.col("b"), F.col("da").eqNullSafe(F.col("db"))).alias("reason"))


@query("""
with l as (select 'u' || user_id as session, event_id, case when event_id % 50 = 0 then null else event_type end as type, epoch_us(ts) as moment from events where event_id % 41 <> 0) ::
select session, count(*) filter (where type is not null) as n, count(*) filter (where type is null) as unread, max(case when type is not null then moment end) as last_at from l group by session
""")
def session_event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files, one a session, as JSON lines: broken lines are counted and left out; blank lines are nothing."""
    from palimpsest.functions.timefns import micros
    from palimpsest.sources import records

    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    line = F.when(i % 41 == 0, "  ").when(i % 50 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), micros(F.col("ts")).alias("at"))))
    lines = e.select(F.concat(F.lit("u"), "user_id").alias("file"), i.alias("line_no"), line.alias("value"))
    told = records.event_lines(lines, "type string, at bigint")
    return told.groupBy(F.col("file").alias("session")).agg(F.count("r.type").alias("n"), F.count_if(F.col("r.type").isNull()).alias("unread"), F.max("r.at").alias("last_at"))


# pages


@query("""
with u as (select page_id, url, regexp_extract(url, '^([^?#]*)', 1) as front, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) as q from pages),
k as (select page_id, front, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_') and lower(split_part(x, '=', 1)) not in ('spm', 'from', 'share_source', 'share_token')), '&') as q from u)
:: select page_id, front || case when q = '' then '' else '?' || q end as url from k
""")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured addresses without tracking keys, otherwise as they are."""
    from palimpsest.functions.textfns import clean_url

    return table(spark, sf_dir, "pages").select("page_id", clean_url(F.col("url")).alias("url"))


_TITLE = "trim(regexp_replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"select page_id, {_TITLE} as title, lower(regexp_extract(html, '(?is)<meta\\b[^>]*?\\bcharset\\s*=\\s*[\"'']?\\s*([^\\s\"''/>;]+)', 1)) as charset from pages")
def readable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and declared character set of every page; a page that declares none has an empty one."""
    title = F.replace(history.page_title(F.col("html")), F.lit("&amp;"), F.lit("&"))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), history.page_charset(F.col("html")).alias("charset"))


_GONE = "|".join([*(f"<{t}\\b.*?</{t}\\s*>" for t in history.HIDDEN), "<!--.*?-->"])
_TAGS = "|".join(history.SPOKEN)


@query(f"""
with a as (select page_id, html, regexp_replace(translate(coalesce(html, ''), chr(1) || chr(2), '  '), '(?is){_GONE}', ' ', 'g') as t from pages),
b as (select page_id, html, regexp_replace(regexp_replace(regexp_replace(t, '(?is)</(?:{_TAGS})\\b[^>]*>', chr(2), 'g'), '(?is)<(?:{_TAGS})\\b[^>]*>', chr(1), 'g'), '(?s)<[^>]*>', ' ', 'g') as t from a),
c as (select page_id, html, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as t from b),
d as (select page_id, html, trim(regexp_replace(array_to_string(list_transform(string_split(t, chr(2)), lambda x: case when contains(x, chr(1)) then regexp_replace(regexp_replace(x, '(?s)^[^\x01]*', ''), '[\x01\\s\\x{{00A0}}]+', ' ', 'g') else '' end), chr(10)), ' *\\n\\s*', chr(10), 'g'), ' ' || chr(10)) as text from c)
:: select page_id, {_TITLE} as title, text, case when length(text) >= 500 then 'content' when html <> '' or text <> '' then 'partial' else 'metadata_only' end as completeness from d
""")
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page says, and how complete the capture is."""
    told = table(spark, sf_dir, "pages").withColumn("text", history.spoken_text(F.col("html")))
    title = F.replace(history.page_title(F.col("html")), F.lit("&amp;"), F.lit("&"))
    return told.select("page_id", title.alias("title"), "text", completeness(F.col("text"), F.lit(""), F.col("html")).alias("completeness"))


# feeds


@query("""
with p as (select * from jobs where path <> '' order by made_at desc, job_id desc limit 60 offset 30), d as (select *, row_number() over (partition by path order by made_at desc, job_id desc) as n from p),
s as (select regexp_extract(path, '[^/]*$') as name, made_at, case when status in ('queued', 'retrying', 'running') then 'processing' when status = 'failed' then 'failed' else 'kept' end as state from d where n = 1)
:: select name, made_at, state, (select count(*) from s) = 60 as has_more from s
""")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the latest entries, each file once: repeats go after the page is cut, and whether more follow is told from what is
    left of it."""
    from palimpsest.functions.textfns import basename

    page = jobs(spark, sf_dir).filter("path <> ''").orderBy(F.desc("made_at"), F.desc("job_id")).offset(30).limit(60)
    last = merge.latest(page.select("path", "made_at", "job_id", "status"), ["path"], ["made_at", "job_id"])
    told = last.select(basename(F.col("path")).alias("name"), "made_at", rules.item_status(F.lit("processed"), F.col("status")).alias("state"))
    more = told.agg((F.count("*") == 60).alias("has_more"))
    return told.crossJoin(F.broadcast(more))


@query("""
with e as (select event_id, event_type, json_extract_string(props, '$.k') as project from events order by event_id desc limit 10000), f as (select * from e where event_id > 120 and event_type in ('error', 'purchase') and project = '3' order by event_id)
:: select event_id, event_type, (select count(*) from f) > 20 as has_more from f order by event_id limit 20
""")
def activity_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset paging over the newest ten thousand events: those of some types and one project after an id, oldest first."""
    newest = table(spark, sf_dir, "events").select("event_id", "event_type", "props").orderBy(F.desc("event_id")).limit(10_000)
    fine = (F.col("event_id") > 120) & F.col("event_type").isin("error", "purchase") & (F.get_json_object("props", "$.k") == "3")
    page = newest.filter(fine).orderBy("event_id").limit(21)
    more = page.agg((F.count("*") > 20).alias("has_more"))
    return page.orderBy("event_id").limit(20).crossJoin(F.broadcast(more)).select("event_id", "event_type", "has_more")


@query("select typeof(props) as kind, case when json_type(props, '$.k') in ('BIGINT', 'UBIGINT') then 'number' else 'other' end as value_kind, count(*) as n, cast(sum(json_array_length('[' || user_id || ',' || event_id || ']')) as bigint) as items from (select props::json as props, user_id, event_id from events) group by 1, 2")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and lengths of JSON values."""
    e = table(spark, sf_dir, "events")
    number = F.get_json_object("props", "$.k").rlike(r"^-?\d+$")
    length = F.json_array_length(F.concat(F.lit("["), "user_id", F.lit(","), "event_id", F.lit("]")))
    rows = e.select(F.lit("JSON").alias("kind"), F.when(number, "number").otherwise("other").alias("value_kind"), length.alias("l"))
    return rows.groupBy("kind", "value_kind").agg(F.count("*").alias("n"), F.sum("l").cast("bigint").alias("items"))
