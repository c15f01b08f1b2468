"""Rules and values on whole tables: filters, findings, cards, paths, loose values, small joins and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import rules, textfns, values
from palimpsest.functions.timefns import strict_instant
from palimpsest.operators import merge, ops, retrieval, search
from palimpsest.plans.registry import query
from palimpsest.plans.search_queries import AS_OF, _reason_sql
from palimpsest.plans.tables import jobs, memories, messages, table


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


# filters


@query("""
select memory_id from memories where (coalesce('', '') = '' or status = '') and project = 'p2' and memory_type in ('decision', 'preference')
  and list_contains(string_split(tags, ' '), 'de')
""")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equality that is not given, one that is, a list, a list that is not given, and a member of a JSON list."""
    rows = memories(spark, sf_dir).withColumn("tags_json", F.to_json(F.split("tags", " ")))
    fine = search.equal_or_any("status", None) & search.equal_or_any("project", "p2") & search.in_or_any("memory_type", ["decision", "preference"])
    return rows.filter(fine & search.in_or_any("privacy", []) & search.json_member("tags_json", "de")).select("memory_id")


@query("""
with v as (select n_nationkey as viewer, case n_nationkey % 3 when 0 then []::varchar[] when 1 then ['private'] else ['private', 'restricted'] end as allowed from nation), n as (select privacy, count(*) as n from memories group by privacy) ::
select viewer, cast(coalesce(sum(n), 0) as bigint) as visible from v left join n on list_contains(allowed, privacy) group by viewer
""")
def visible_to_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many memories each viewer may see: here an empty list of classes denies all. Memories are counted by class first."""
    k = F.col("n_nationkey") % 3
    allowed = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("private"))).otherwise(F.array(F.lit("private"), F.lit("restricted")))
    viewers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("viewer"), F.explode_outer(allowed).alias("privacy"))
    classes = memories(spark, sf_dir).groupBy("privacy").agg(F.count("*").alias("n"))
    return viewers.join(classes, "privacy", "left").groupBy("viewer").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visible"))


@query("""
select page_id from pages where url ilike '%utm$_source%' escape '$' or url ilike '%100$%%' escape '$' or url ilike '%PAGE=2%' escape '$' or html ilike '%it''s%' escape '$'
""")
def like_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text over several columns; '%' and '_' stand for themselves, case of ASCII letters does not count."""
    cols = ["url", "html"]
    texts = [("utm_source", cols[:1]), ("100%", cols[:1]), ("PAGE=2", cols[:1]), ("it's", cols[1:])]
    hit = F.lit(False)
    for text, where in texts:
        hit = hit | search.like_any(where, text)
    return table(spark, sf_dir, "pages").filter(hit).select("page_id")


@query("select job_id from jobs where path ilike '%inbox/_2%' or reason ilike '%disk%bytes%'")
def queue_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's free text is not escaped: '%' and '_' stay wildcards."""
    return jobs(spark, sf_dir).filter(F.col("path").ilike("%inbox/_2%") | F.col("reason").ilike("%disk%bytes%")).select("job_id")


@query("select event_id from events where json_extract_string(props, '$.k') = '7'")
def json_path_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("select memory_id from memories where valid_from is not null and valid_from >= '2026-01-05' and valid_from < '2026-01-20T00'")
def time_range_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both bounds compare as text and leave out rows without a time."""
    c = F.col("valid_from")
    return memories(spark, sf_dir).filter(c.isNotNull() & (c >= "2026-01-05") & (c < "2026-01-20T00")).select("memory_id")


@query("""
select memory_id from memories where not starts_with(heading || '/' || title, 'fr/') and privacy in ('private', 'restricted') and status = 'active'
  and review in ('', 'approved') and (scope = '' or list_contains(string_split(scope, ','), 'all') or list_contains(string_split(scope, ','), 'a1')) and project = 'p5'
""")
def project_pack_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "heading", "title")
    rows = memories(spark, sf_dir).filter(~F.startswith(path, F.lit("fr/")) & F.col("privacy").isin("private", "restricted") & (F.col("status") == "active"))
    return rows.filter(F.col("review").isin("", "approved") & search.scope_visible(F.col("scopes"), "a1") & (F.col("project") == "p5")).select("memory_id")


@query("""
with c as (select *, case when status = '' then 'unknown' else status end as freshness, case when review = 'approved' then 'available' else 'pending' end as permanent from memories)
:: select memory_id from c where 'archived' in (lower(memory_type), freshness, permanent) and lower(title) = 'src3'
""")
def card_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wanted state may be a card's kind, freshness or layer; the source is matched without regard to case."""
    state = F.array(F.lower("memory_type"), F.when(F.col("status") == "", "unknown").otherwise(F.col("status")), F.when(F.col("review") == "approved", "available").otherwise("pending"))
    return memories(spark, sf_dir).filter(F.array_contains(state, "archived") & (F.lower("title") == "src3")).select("memory_id")


_SIGNAL = " or ".join("regexp_matches(content, '" + p.replace("'", "''") + "')" for p in rules.VALUE_SIGNALS)


@query(f"""
with g as (select conversation_id, count(*) as n, cast(sum(length(content)) as bigint) as chars, bool_or({_SIGNAL}) as signal from messages where content <> '' group by conversation_id)
:: select conversation_id, n, chars, signal, not (n < 12 and chars < 2000 and not signal) as approved from g
""")
def session_value_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value gate with its own signals; thresholds are raised so that both outcomes occur."""
    said = messages(spark, sf_dir).filter("content <> ''")
    signal = F.lit(False)
    for p in rules.VALUE_SIGNALS:
        signal = signal | F.col("content").rlike(p)
    g = said.groupBy("conversation_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("bigint").alias("chars"), F.bool_or(signal).alias("signal"))
    return g.withColumn("approved", ~((F.col("n") < 12) & (F.col("chars") < 2000) & ~F.col("signal")))


@query(f"""
with s as (select conversation_id from messages where content <> '' group by conversation_id having count(*) < 6 and sum(length(content)) < 3000),
low as (select conversation_id from messages join s using (conversation_id) group by conversation_id having not bool_or({_SIGNAL}))
:: select message_id from messages m where not exists (select 1 from low where low.conversation_id = m.conversation_id)
""")
def evidence_value_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of conversations above the floor; signals are looked for in short conversations only."""
    m = messages(spark, sf_dir)
    sizes = m.filter("content <> ''").groupBy("conversation_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")).filter("n < 6 and chars < 3000").select("conversation_id")
    signal = F.lit(False)
    for p in rules.VALUE_SIGNALS:
        signal = signal | F.col("content").rlike(p)
    low = m.join(sizes, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.bool_or(signal).alias("s")).filter("not s").select("conversation_id")
    return m.join(low, "conversation_id", "left_anti").select("message_id")


_PATHS = """
p as (
  select doc_id, case doc_id % 12 when 0 then '08-Private/' || source when 1 then '00-System/Logs/' || source when 2 then '01-Inbox/AI-Memory/' || source
    when 3 then '02-Work/.hidden/' || source when 4 then 'node_modules/' || source when 5 then '09-Archive/' || source when 6 then '00-System/' || source
    when 7 then 'Library/' || source when 8 then '../' || source when 9 then 'Plain' else '03-Projects/' || lang || '/' || source end || case when doc_id % 5 = 0 then '.txt' else '.md' end as path,
  case doc_id % 7 when 0 then 'true' when 1 then 'false' when 2 then 'maybe' end as flag from documents
)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = ["08-Private/", "00-System/Logs/", "01-Inbox/AI-Memory/", "02-Work/.hidden/", "node_modules/", "09-Archive/", "00-System/", "Library/", "../"]
    i = F.col("doc_id")
    path = F.when(i % 12 == 9, "Plain")
    for k, top in enumerate(tops):
        path = path.when(i % 12 == k, F.concat(F.lit(top), "source"))
    path = F.concat(path.otherwise(F.concat(F.lit("03-Projects/"), "lang", F.lit("/"), "source")), F.when(i % 5 == 0, ".txt").otherwise(".md"))
    flag = F.when(i % 7 == 0, "true").when(i % 7 == 1, "false").when(i % 7 == 2, "maybe")
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), flag.alias("flag"))


_BAD = " or ".join(f"list_contains(string_split(path, '/'), '{d}')" for d in rules.EXCLUDED_FOLDERS)
_PREFIX = " or ".join(f"path = '{p}' or starts_with(path, '{p}/')" for p in rules.EXCLUDED_PREFIXES)
_INDEXED = f"not ({_BAD} or len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) > 0 or {_PREFIX} or split_part(path, '/', 1) = '08-Private')"


@query(f"""
with {_PATHS} :: select doc_id, {_INDEXED} as indexed,
  {_INDEXED} and not (split_part(path, '/', 1) = '01-Inbox' and split_part(path, '/', 2) = 'AI-Memory') and split_part(path, '/', 1) not in {_in(rules.NOT_ANALYSED)} as analysed,
  case when split_part(path, '/', 1) = '08-Private' then 'restricted' else 'private' end as privacy,
  lower(case when contains(split_part(path, '/', 1), '-') then regexp_extract(split_part(path, '/', 1), '^[^-]*-(.*)$', 1) else split_part(path, '/', 1) end) as category from p
""")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    told = rules.path_class(p)
    return _paths(spark, sf_dir).select("doc_id", rules.indexed_path(p).alias("indexed"), rules.analysed_path(p).alias("analysed"), told.privacy.alias("privacy"), told.category.alias("category"))


@query(f"""
with {_PATHS}, r as (
  select doc_id, case when starts_with(path, '/') or contains('/' || path || '/', '/../') then 'outside_vault' when not ends_with(lower(path), '.md') then 'non_markdown'
    when flag = 'false' then 'explicitly_disabled' when flag is not null and flag <> 'true' then 'invalid_frontmatter' when flag = 'true' then 'explicitly_enabled'
    when path = 'Library' or starts_with(path, 'Library/') then 'authorized' else 'excluded_ordinary' end as reason from p
) :: select doc_id, reason, reason in ('explicitly_enabled', 'authorized') as eligible from r
""")
def memory_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = rules.memory_scope(F.col("path"), F.col("flag"), ["Library"])
    return _paths(spark, sf_dir).select("doc_id", told.alias("t")).select("doc_id", "t.reason", "t.eligible")


_TITLES = "t as (select doc_id, case doc_id % 6 when 0 then 'Task 12 ' || source when 1 then '导入失败 ' || source when 2 then '失败已修复' when 3 then 'README.md' when 4 then '超时 ' || lang else source end as title from documents)"


@query(f"""
with {_TITLES} :: select doc_id, regexp_matches(title, '{rules.PROCESS_LOG}') as process_log,
  ({" or ".join(f"contains(title, '{m}')" for m in rules.NOTIFICATION_MARKERS)}) and not ({" or ".join(f"contains(title, '{m}')" for m in rules.CONCLUSION_MARKERS)}) as notification from t
""")
def title_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("doc_id") % 6, F.col("source")
    title = F.when(i == 0, F.concat(F.lit("Task 12 "), s)).when(i == 1, F.concat(F.lit("导入失败 "), s)).when(i == 2, "失败已修复").when(i == 3, "README.md").when(i == 4, F.concat(F.lit("超时 "), "lang")).otherwise(s)
    return table(spark, sf_dir, "documents").select("doc_id", rules.process_log_title(title).alias("process_log"), rules.notification_title(title).alias("notification"))


_KINDS = ["mixed_sessions", "nothing_readable", "too_large", "unknown_format", "linked_file"]


@query("""
with f as (select event_id, case event_id % 8 when 0 then 'Found DISTINCT session_meta rows' when 1 then 'no supported messages in file' when 2 then 'row exceeds bounded size' when 3 then 'unknown codex rollout item'
  when 4 then 'path is a Symlink' when 5 then '  ' when 6 then null else event_type end as error from events) ::
select event_id, case when contains(lower(error), 'distinct session_meta') then 'mixed_sessions' when contains(lower(error), 'no supported messages') then 'nothing_readable'
  when contains(lower(error), 'exceeds bounded size') then 'too_large' when contains(lower(error), 'unknown codex rollout') then 'unknown_format' when contains(lower(error), 'symlink') then 'linked_file'
  when trim(coalesce(error, '')) <> '' then 'other' else 'unknown' end as kind from f
""")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ["Found DISTINCT session_meta rows", "no supported messages in file", "row exceeds bounded size", "unknown codex rollout item", "path is a Symlink", "  "]
    error = F.when(F.col("event_id") % 8 == 7, F.col("event_type"))
    for k, text in enumerate(said):
        error = error.when(F.col("event_id") % 8 == k, text)
    return table(spark, sf_dir, "events").select("event_id", rules.failure_kind(error, _KINDS).alias("kind"))


@query("""
with s as (select *, string_split(tags || ' ' || source || '  ' || lang, ' ') as refs from (select *, lang || ' ' || source as tags, case when doc_id % 5 = 0 then 'note' else 'decision' end as kind from documents)) ::
select doc_id, kind = 'note' or len(list_distinct(list_filter(list_transform(refs, lambda x: trim(x)), lambda x: x <> ''))) >= 3 as sufficient from s
""")
def evidence_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.split(F.concat("lang", F.lit(" "), "source", F.lit(" "), "source", F.lit("  "), "lang"), " ")
    kind = F.when(F.col("doc_id") % 5 == 0, "note").otherwise("decision")
    return table(spark, sf_dir, "documents").select("doc_id", rules.evidence_sufficient(kind, refs, 3).alias("sufficient"))


@query("""
with c as (select *, memory_id % 7 = 0 as conflict, importance >= 2 as evidence, case memory_id % 4 when 0 then 'Delete ' when 1 then 'merge' else '' end as operation,
  case memory_id % 3 when 0 then 'codex' else 'chat' end as source, case memory_id % 5 when 0 then 'FAILED' else 'done' end as report from memories) ::
select memory_id, concat_ws(',', case when coalesce(title, '') = '' or coalesce(text, '') = '' then 'schema_invalid' end, case when tier = 'core' then 'core_memory_requires_owner' end,
  case when trim(lower(operation)) in ('delete') then 'destructive_operation_requires_owner' end, case when memory_id % 41 = 0 then 'privacy_change_requires_owner' end,
  case when privacy = 'restricted' then 'restricted_content_requires_owner' end, case when project <> 'p3' and memory_id % 2 = 0 then 'cross_project_requires_owner' end,
  case when conflict then 'knowledge_conflict_requires_owner' end, case when not evidence then 'insufficient_evidence_requires_owner' end,
  case when source = 'codex' and report = 'FAILED' then 'unverified_work_report_requires_owner' end, case when memory_id % 43 = 0 or contains(' ' || tags || ' ', ' src9 ') then 'owner_authored_requires_owner' end) as findings from c
""")
def hard_rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, in order."""
    i = F.col("memory_id")
    own = F.when(F.array_contains(F.split("tags", " "), "src9"), F.array(F.lit("source/owner-manual"))).otherwise(F.array().cast("array<string>"))
    facts = {
        "memory_id": i, "title": F.col("title"), "content": F.col("text"), "memory_type": F.col("memory_type"), "tier": F.col("tier"), "privacy": F.col("privacy"),
        "operation": F.when(i % 4 == 0, "Delete ").when(i % 4 == 1, "merge").otherwise(""), "privacy_change": i % 41 == 0, "target_project": F.when(i % 2 == 0, "p3").otherwise(""),
        "projects": F.array("project"), "conflict": i % 7 == 0, "evidence": F.col("importance") >= 2, "source": F.when(i % 3 == 0, "codex").otherwise("chat"),
        "report_status": F.when(i % 5 == 0, "FAILED").otherwise("done"), "owner_authored": i % 43 == 0, "tags": own,
    }
    return memories(spark, sf_dir).select("memory_id", F.array_join(rules.hard_findings(facts), ",").alias("findings"))


@query("""
with c as (select *, case memory_id % 4 when 0 then 0.95 when 1 then 0.5 when 2 then 'nan'::double end as confidence, case when memory_id % 6 = 0 then 'Legal' when memory_id % 6 = 1 then 'security' end as flag from memories) ::
select memory_id, concat_ws(',', case when coalesce(title, '') = '' or coalesce(text, '') = '' then 'schema_invalid' end,
  case when confidence is null or isnan(confidence) or confidence < 0.9 then 'confidence_below_threshold' end, case when authority < 20 then 'direct_user_or_authoritative_source_required' end,
  case when importance = 0 then 'evidence_required' end, case when importance = 1 then 'evidence_reference_unverifiable' end, case when memory_id % 7 = 0 then 'unresolved_conflict' end,
  case when memory_id % 11 = 0 then 'duplicate_ambiguity' end, case when tier = 'core' then 'core_memory_requires_owner' end, case when privacy = 'restricted' then 'restricted_requires_owner' end,
  lower(flag) || '_requires_owner') as reasons from c
""")
def promotion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("memory_id")
    none = F.array().cast("array<string>")
    facts = {
        "memory_id": i, "title": F.col("title"), "content": F.col("text"), "memory_type": F.col("memory_type"), "tier": F.col("tier"), "privacy": F.col("privacy"),
        "confidence": F.when(i % 4 == 0, 0.95).when(i % 4 == 1, 0.5).when(i % 4 == 2, float("nan")), "authoritative": F.col("authority") >= 20,
        "refs": F.when(F.col("importance") > 0, F.array("title")).otherwise(none), "verifiable": F.col("importance") > 1, "conflict": i % 7 == 0, "ambiguous": i % 11 == 0,
        "flags": F.when(i % 6 == 0, F.array(F.lit("Legal"), F.lit("odd"))).when(i % 6 == 1, F.array(F.lit(" security "))).otherwise(none),
    }
    return memories(spark, sf_dir).select("memory_id", F.array_join(rules.policy_reasons(facts), ",").alias("reasons"))


@query("""
with j as (select *, case job_id % 5 when 0 then 'job:17:existing' when 1 then 'queued' when 2 then 'Processed' when 3 then 'skipped_by_value_gate' end as manifest, case when job_id % 3 > 0 then status end as job from jobs) ::
select job_id, case when job = 'failed' then 'failed' when job in ('queued', 'retrying', 'running') then 'processing'
  when job = 'completed' then case when starts_with(manifest, 'job:') and contains(manifest, ':existing') then 'merged' else 'kept' end
  when lower(manifest) = 'skipped_by_value_gate' then 'skipped' when lower(manifest) = 'queued' then 'pending' when lower(manifest) = 'failed' then 'failed' when lower(manifest) = 'processed' then 'kept' else 'pending' end as item from j
""")
def item_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("job_id")
    manifest = F.when(i % 5 == 0, "job:17:existing").when(i % 5 == 1, "queued").when(i % 5 == 2, "Processed").when(i % 5 == 3, "skipped_by_value_gate")
    return jobs(spark, sf_dir).select("job_id", rules.item_status(manifest, F.when(i % 3 > 0, F.col("status"))).alias("item"))


_CARDS = """
c as (select *, case when memory_id % 20 = 0 then 'revoked' else 'active' end as source, case when memory_id % 21 = 1 then 'needs_review' else status end as state,
  case when memory_id % 17 = 0 or memory_id % 3 > 0 and memory_id % 23 = 0 then 'malformed' when valid_from is null and valid_to is null then 'unbounded'
    when valid_to is not null and memory_id % 28 + 1 <= 10 then 'expired' when valid_from is not null and memory_id % 28 + 1 > 25 then 'not_yet_valid' else 'valid' end as reason from memories),
f as (select *, case when source = 'revoked' then 'source_revoked' when state in ('superseded', 'archived') then state when reason = 'malformed' then 'unknown'
  when reason = 'unbounded' then case when state = 'active' and tier = 'core' and review = 'approved' then 'current' else 'unknown' end
  when reason = 'expired' then 'overdue' when reason = 'not_yet_valid' then 'not_yet_current' else 'current' end as freshness from c),
a as (select *, case when source = 'revoked' then 'reauthorize_source' when state = 'needs_review' then 'confirm' when tier = 'core' and (state in ('archived', 'superseded') or freshness in ('archived', 'superseded')) then 'review'
  when tier = 'core' and freshness = 'overdue' then 'invalidate' when tier = 'core' and (state in ('active', 'superseded') or review = 'approved') then 'correct'
  when freshness in ('superseded', 'archived', 'overdue', 'source_revoked') then 'review' when authority < 10 then 'review' else 'none' end as action from f)"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, status = F.col("memory_id"), F.col("status")
    at, none = i % 28 + 1, F.col("valid_from").isNull() & F.col("valid_to").isNull()
    reason = F.when((i % 17 == 0) | ((i % 3 > 0) & (i % 23 == 0)), "malformed").when(none, "unbounded").when(F.col("valid_to").isNotNull() & (at <= 10), "expired").when(F.col("valid_from").isNotNull() & (at > 25), "not_yet_valid").otherwise("valid")
    source, state = F.when(i % 20 == 0, "revoked").otherwise("active"), F.when(i % 21 == 1, "needs_review").otherwise(status)
    core, approved = F.col("tier") == "core", F.col("review") == "approved"
    rows = memories(spark, sf_dir).select("*", source.alias("source"), state.alias("state"), reason.alias("reason"))
    fresh = rows.withColumn("freshness", rules.card_freshness(F.col("source"), F.col("state"), F.col("reason"), (F.col("state") == "active") & core & approved))
    return fresh.withColumn("action", rules.card_action(F.col("source"), F.col("state"), F.col("freshness"), F.lit(False), core, approved, F.col("authority") < 10))


@query(f"with {_CARDS} :: select memory_id, freshness, action from a")
def owner_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness and the action that an owner is asked for, of every card."""
    return _cards(spark, sf_dir).select("memory_id", "freshness", "action")


@query(f"""
with {_CARDS}, o as (select memory_id, action, try_cast(case when regexp_matches(valid_from, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') then valid_from end as timestamptz) as moment from a where action in ('correct', 'review'))
:: select memory_id, action, count(*) over () as total, count(*) over () > 45 as has_more from o order by moment is null, moment desc, memory_id desc limit 25 offset 20
""")
def owner_cards_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest evidence first by instant, malformed times last, ties by id; limits outside 1..50 are an error."""
    rows = _cards(spark, sf_dir).filter(F.col("action").isin("correct", "review")).withColumn("at", strict_instant(F.col("valid_from")))
    return search.page(rows, [F.desc_nulls_last("at"), F.desc("memory_id")], 25, 20, most=50).select("memory_id", "action", "total", "has_more")


# loose values


_LOOSE = """
v as (select event_id, case event_id % 9 when 0 then null when 1 then '' when 2 then '["a","b"]' when 3 then 'a,b' when 4 then ' YES ' when 5 then 'on' when 6 then ' 2.5' when 7 then '[1' else props end as c from events)"""


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("event_id") % 9 == 8, F.col("props"))
    for k, text in enumerate(["", '["a","b"]', "a,b", " YES ", "on", " 2.5", "[1"], 1):
        c = c.when(F.col("event_id") % 9 == k, text)
    return table(spark, sf_dir, "events").select("event_id", c.alias("c"))


@query(f"""
with {_LOOSE} :: select event_id, case when c is null or c = '' then '' when c = '["a","b"]' then 'a|b' else c end as items, coalesce(lower(trim(c)) in ('1', 'true', 'yes', 'on'), false) as flag,
  coalesce(try_cast(trim(c) as double), 1.0) as number, coalesce(try_cast(json_extract(try_cast(c as json), '$.k') as bigint), -1) as k from v
""")
def loose_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, flags, numbers and JSON given loosely, each with its default."""
    c = F.col("c")
    k = values.json_or(c, "struct<k:bigint>", F.struct(F.lit(-1).cast("bigint").alias("k")))["k"]
    return _loose(spark, sf_dir).select("event_id", F.array_join(values.as_list(c), "|").alias("items"), values.as_bool(c).alias("flag"), values.as_number(c).alias("number"), F.coalesce(k, F.lit(-1)).alias("k"))


@query("""
select doc_id, '{"lang":"' || lang || '","n":"' || n_chars || '","source":"' || source || '"}' as canonical, sha256('{"kind":"note","parts":["' || source || '"],"tags":["' || lang || '","z"],"weight":' || (doc_id % 4) || '.5}') as request from documents
""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map as JSON in the order of its keys, and the digest of a request whose set is sorted."""
    pairs = F.create_map(F.lit("source"), F.col("source"), F.lit("n"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang"))
    key = values.request_key(F.lit("note"), F.array("source"), F.array(F.lit("z"), F.col("lang"), F.lit("z")), F.col("doc_id") % 4 + F.lit(0.5))
    return table(spark, sf_dir, "documents").select("doc_id", values.canonical_json(pairs).alias("canonical"), key.alias("request"))


@query("""
with t as (select memory_id, case memory_id % 5 when 0 then valid_from when 1 then replace(valid_from, 'Z', '') when 2 then '17' || lpad(cast(memory_id as varchar), 8, '0') when 3 then '' else 'soon' end as c from memories) ::
select memory_id, epoch(try_cast(case when regexp_matches(c, '(Z|[+-][0-9]{2}:?[0-9]{2})$') then c when length(c) > 12 then c || 'Z' end as timestamptz))::bigint as instant,
  case when c is null or c = '' then '' when try_cast(c as double) is not null then strftime(make_timestamp((c::bigint) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') when length(c) > 12 then substr(c, 1, 19) || '+00:00' else c end as shown from t
""")
def loose_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with and without zone (then UTC), epochs, and texts that are no time."""
    i, v = F.col("memory_id"), F.col("valid_from")
    c = F.when(i % 5 == 0, v).when(i % 5 == 1, F.replace(v, F.lit("Z"), F.lit(""))).when(i % 5 == 2, F.concat(F.lit("17"), F.lpad(i.cast("string"), 8, "0"))).when(i % 5 == 3, "").otherwise("soon")
    rows = memories(spark, sf_dir).select("memory_id", c.alias("c"))
    like_time = F.when(F.length("c") > 12, values.lenient_instant(F.col("c")))
    return rows.select("memory_id", F.unix_timestamp(like_time).alias("instant"), values.iso_second(F.col("c")).alias("shown"))


@query("""
with d as (select doc_id, source || ' · ' || lang || '/v' || doc_id || '?' as c, case doc_id % 4 when 0 then 'https://host/x/' || source || '/' || lang || '.git' when 1 then 'git@host:' || source || '/' || lang when 2 then source when 3 then '' end as r from documents),
m as (select *, case doc_id % 4 when 0 then source || '/' || lang when 1 then source || '/' || lang else '' end as repo from (select d.*, documents.source, documents.lang from d join documents using (doc_id))) ::
select doc_id, regexp_replace(trim(c), '[^A-Za-z0-9_.:-]', '_', 'g') as token, lower(trim(regexp_replace(substr(c, 1, 30), '[^0-9A-Za-z_\\x{4e00}-\\x{9fff}-]+', '_', 'g'), '_')) as slug,
  regexp_replace(c, '[/?]', '_', 'g') as file, repo, 'PROJ-' || upper(split_part(repo, '/', 2)) as project from m
""")
def names_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat("source", F.lit(" · "), "lang", F.lit("/v"), "doc_id", F.lit("?"))
    i = F.col("doc_id") % 4
    r = F.when(i == 0, F.concat(F.lit("https://host/x/"), "source", F.lit("/"), "lang", F.lit(".git"))).when(i == 1, F.concat(F.lit("git@host:"), "source", F.lit("/"), "lang")).when(i == 2, F.col("source")).otherwise("")
    repo = values.repository(r)
    return table(spark, sf_dir, "documents").select("doc_id", values.safe_token(c).alias("token"), values.slug(c).alias("slug"), values.file_name(c).alias("file"), repo.alias("repo"), values.project_of(repo).alias("project"))


@query("""
with c as (select doc_id, trim(text) as c, 60 as budget from documents), s as (select *, substr(c, 1, budget - 1) as head from c),
b as (select *, greatest(case when contains(head, chr(10)) then length(head) - strpos(reverse(head), chr(10)) else -1 end, case when contains(head, '. ') then length(head) - strpos(reverse(head), ' .') - 1 else -1 end) as last from s) ::
select doc_id, case when c = '' then '' when length(c) <= budget then c else regexp_replace(substr(c, 1, case when last < budget // 2 then budget - 1 else last end + 1), '\\s+$', '') || '…' end as cut from b where not regexp_matches(head, '。') and c = regexp_replace(c, '^\\s+|\\s+$', '', 'g')
""")
def natural_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts (without other outer blanks) cut at sixty characters, after a sentence or line where one ends in the second half."""
    rows = table(spark, sf_dir, "documents").filter(F.trim("text") == F.regexp_replace(F.trim("text"), r"^\s+|\s+$", ""))
    return rows.filter(~F.contains(F.left(F.trim("text"), F.lit(59)), F.lit("。"))).select("doc_id", values.natural_cut(F.col("text"), F.lit(60)).alias("cut"))


@query("""
select doc_id, case when doc_id % 3 = 0 then source end as liked, case when doc_id % 4 > 1 then lang || ' x' end as failed, 'H' || doc_id as heading from documents
""")
def feedback_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an owner wrote behind labels of a note, and the note's first heading."""
    i = F.col("doc_id")
    liked = F.concat(F.lit("喜欢的机会："), F.when(i % 3 == 0, F.col("source")).otherwise("无"))
    failed = F.concat(F.lit("失败的: "), F.when(i % 4 > 1, F.concat("lang", F.lit(" x"))).otherwise("-"))
    note = F.concat(F.lit("intro\n# H"), i.cast("string"), F.lit("\n"), liked, F.lit("\n"), failed, F.lit("\n# Other\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", note.alias("note"))
    n = F.col("note")
    return rows.select("doc_id", values.noted(n, ["喜欢/感兴趣", "喜欢的机会"]).alias("liked"), values.noted(n, ["失败的"]).alias("failed"), values.first_heading(n).alias("heading"))


@query("""
select page_id, case when page_id % 11 = 0 then 'video_channel' when page_id % 11 = 1 then 'wechat_article' when page_id % 11 = 2 then 'douyin' when page_id % 11 = 3 then 'youtube' when page_id % 11 = 4 then 'forum' else 'website' end as platform,
  case when page_id % 4 = 0 then 'full' when page_id % 4 = 1 then 'content' when page_id % 4 = 2 then 'partial' else 'metadata_only' end as completeness from pages
""")
def capture_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    url = F.when(i % 11 == 1, "https://mp.weixin.qq.com/s").when(i % 11 == 2, "http://www.iesdouyin.com/x").when(i % 11 == 3, "https://youtu.be/x").otherwise(F.col("url"))
    hint = F.when(i % 11 == 0, "Video-Channel").when(i % 11 == 4, "forum")
    text = F.when(i % 4 == 0, "short").when(i % 4 == 1, F.repeat(F.lit("x"), F.lit(500))).when(i % 4 == 2, "short").otherwise("")
    level = textfns.completeness(text, F.when(i % 4 == 0, "said").otherwise(""), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", rules.platform(url, hint).alias("platform"), level.alias("completeness"))


@query("""
select event_id, event_id % 3 = 0 as sensitive, '{"k":' || json_extract_string(props, '$.k') || '}' as props, '{"a":"x","api_key":"[REDACTED]"}' as shown, 'https://host/' || user_id as url from events
""")
def safe_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret keys are found at any depth and their values masked; a URL loses user, query and fragment."""
    nested = F.when(F.col("event_id") % 3 == 0, '{"a":[{"Access_Token":1}]}').otherwise('{"a":"token"}')
    shown = rules.masked(F.create_map(F.lit("a"), F.lit("x"), F.lit("api_key"), F.lit("v")))
    url = F.concat(F.lit("https://me:pw@host/"), "user_id", F.lit("?q=1#f"))
    k = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", rules.sensitive(nested).alias("sensitive"), k.alias("props"), F.to_json(shown).alias("shown"), rules.bare_url(url).alias("url"))


# joins


@query("""
select m.message_id, c.n from messages m join (select conversation_id, count(*) as n from messages group by conversation_id) c using (conversation_id)
  where m.role = 'user'
""")
def two_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.filter("role = 'user'").join(m.groupBy("conversation_id").agg(F.count("*").alias("n")), "conversation_id").select("message_id", "n")


@query("""
with p as (select source_id, conversation_id, sequence from messages where role = 'assistant') ::
select m.message_id from messages m join p on p.source_id = m.source_id and p.conversation_id = m.conversation_id and p.sequence = m.sequence + 1
""")
def composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that an answer follows, by three columns."""
    m = messages(spark, sf_dir)
    p = m.filter("role = 'assistant'").select("source_id", "conversation_id", (F.col("sequence") - 1).alias("sequence"))
    return m.join(p, ["source_id", "conversation_id", "sequence"]).select("message_id")


@query("""
select memory_id, case when status = '' then 'emptied' else 'orphan' end as why from memories d where memory_type = 'decision' and (status = ''
  or not exists (select 1 from messages m where m.conversation_id = d.memory_id % 120 and m.sequence = d.importance))
""")
def orphaned_or_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence whose message (two columns) is gone, or which holds nothing any more."""
    d = memories(spark, sf_dir).filter("memory_type = 'decision'").select("memory_id", "status", (F.col("memory_id") % 120).alias("conversation_id"), F.col("importance").cast("bigint").alias("sequence"))
    m = messages(spark, sf_dir).select("conversation_id", "sequence")
    gone = d.filter("status <> ''").join(m, ["conversation_id", "sequence"], "left_anti").select("memory_id", F.lit("orphan").alias("why"))
    return d.filter("status = ''").select("memory_id", F.lit("emptied").alias("why")).unionByName(gone)


@query("""
select memory_id from memories d where tier = 'normal' and exists (select 1 from jobs j where j.source_id = 's' || (d.memory_id % 20) and j.status =
  'failed' and j.attempts >= 6)
""")
def low_value_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = memories(spark, sf_dir).filter("tier = 'normal'").select("memory_id", F.concat(F.lit("s"), F.col("memory_id") % 20).alias("source_id"))
    return d.join(jobs(spark, sf_dir).filter("status = 'failed' and attempts >= 6").select("source_id"), "source_id", "left_semi").select("memory_id")


@query("""
with g as (select c_custkey, o_orderkey, o_orderdate + interval 90 day as expires from customer join orders on o_custkey = c_custkey), n as (select max(o_orderdate) as now from orders) ::
select o_orderkey, n_name, expires > now as valid from g join customer using (c_custkey) join nation on n_nationkey = c_nationkey, n where expires > now - interval 30 day
""")
def authority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants with their holder and region, and whether they still hold at the latest time known."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    now = o.agg(F.max("o_orderdate").alias("now"))
    g = o.withColumn("expires", F.col("o_orderdate") + F.expr("interval 90 days")).crossJoin(F.broadcast(now)).filter("expires > now - interval 30 days")
    return g.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name", (F.col("expires") > F.col("now")).alias("valid"))


@query("""
with t as (select distinct user_id from events where event_id > (select max(event_id) - 200 from events)) :: select event_id from events semi join t
  using (user_id)
""")
def touched_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the sessions that have rows above a watermark; the sessions are read anew as a whole."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    top = e.agg((F.max("event_id") - 200).alias("w"))
    return merge.increment(e, e.crossJoin(F.broadcast(top)).filter("event_id > w"), "user_id").select("event_id")


@query("""
select m.message_id, p.memories from messages m join (select conversation_id, max(sequence) as last from messages group by conversation_id) c using
  (conversation_id) left join (select project, count(*) as memories from memories where tier = 'core' group by project) p on p.project = 'p' ||
  (m.conversation_id % 11) where m.sequence = c.last
""")
def inner_then_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    c = m.groupBy("conversation_id").agg(F.max("sequence").alias("last"))
    p = memories(spark, sf_dir).filter("tier = 'core'").groupBy("project").agg(F.count("*").alias("memories"))
    last = m.join(c, "conversation_id").filter("sequence = last").withColumn("project", F.concat(F.lit("p"), F.col("conversation_id") % 11))
    return last.join(p, "project", "left").select("message_id", "memories")


# aggregates and measures


@query("select lang, count(*) as n from documents where length(trim(text)) > 0 and n_chars >= 200 group by lang")
def ready_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = table(spark, sf_dir, "documents").filter((F.length(F.trim("text")) > 0) & (F.col("n_chars") >= 200))
    return ready.groupBy("lang").agg(F.count("*").alias("n"))


@query("""
with last as (select * from (select *, row_number() over (partition by path order by made_at desc, job_id desc) as p from jobs) where p = 1) ::
select count(*) as total, count(*) filter (where status = 'queued') as queued, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'retrying') as retrying,
  count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed, count(*) filter (where status in ('queued', 'running', 'retrying')) as pending from last
""")
def job_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven figures over the latest job of each path."""
    last = merge.latest(jobs(spark, sf_dir).select("path", "job_id", "status", "made_at"), ["path"], ["made_at", "job_id"])
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return last.agg(F.count("*").alias("total"), *(is_(s).alias(s) for s in ("queued", "running", "retrying", "completed", "failed")), is_("queued", "running", "retrying").alias("pending"))


@query("select title, max(importance) + 1 as next_version from memories group by title union all select 'none', 1")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that comes next; one for a key that has none yet."""
    known = memories(spark, sf_dir).groupBy("title").agg(F.max("importance").alias("v"))
    asked = known.select("title").union(spark.createDataFrame([("none",)], "title string"))
    return asked.join(known, "title", "left").select("title", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


@query("""
with g as (select scan, status, count(*) as n from jobs group by scan, status), l as (select scan, arg_max(status, struct_pack(a := made_at, b := job_id)) as last_status, max(made_at) as last_at from jobs group by scan) ::
select scan, status, n, last_status, last_at from g join l using (scan)
""")
def scan_counts_with_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    last = j.groupBy("scan").agg(F.max_by("status", F.struct("made_at", "job_id")).alias("last_status"), F.max("made_at").alias("last_at"))
    return j.groupBy("scan", "status").agg(F.count("*").alias("n")).join(last, "scan").select("scan", "status", "n", "last_status", "last_at")


_STEPS = ["fetch", "parse", "dedupe", "filter", "extract", "judge", "memory", "timeline", "vectorize"]


@query("""
with c as (select count(*) as total, count(*) filter (where status = 'completed') as parse, count(*) filter (where attempts = 1) as dedupe, count(*) filter (where status = 'failed') as "filter", cast(sum(k) as bigint) as extract,
  count(*) filter (where status = 'queued') as judge, count(distinct path) as memory from jobs), s as (select 'fetch' as step, total as n, total from c union all select 'parse', parse, total from c union all select 'dedupe', dedupe, total from c
  union all select 'filter', "filter", total from c union all select 'extract', extract, total from c union all select 'judge', judge, total from c union all select 'memory', memory, total from c
  union all select 'timeline', null, total from c union all select 'vectorize', null, total from c) :: select step, n, cast(greatest(0, least(100, round_even(n * 100.0::double / total, 0))) as int) as percent from s
""")
def nine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and percents of the nine steps of a pipeline; what was not measured stays null."""
    from palimpsest.functions.timefns import percent

    s, none = F.col("status"), F.lit(None).cast("bigint")
    figures = [F.count("*"), F.count_if(s == "completed"), F.count_if(F.col("attempts") == 1), F.count_if(s == "failed"), F.sum("k"), F.count_if(s == "queued"), F.count_distinct("path"), none, none]
    one = jobs(spark, sf_dir).agg(F.count("*").alias("total"), *(f.alias(n) for f, n in zip(figures, _STEPS, strict=True)))
    return one.unpivot("total", _STEPS, "step", "n").select("step", "n", percent(F.col("n"), F.col("total")).alias("percent"))


@query("""
with h as (select source_id, bool_or(status = 'failed' and attempts >= 6) as rebuild, count(*) filter (where status = 'completed') as done, count(*) filter (where status = 'completed')::double / count(*) as cover from jobs group by source_id),
v as (select source_id, case when rebuild then 'degraded' when done = 0 then 'unavailable' when cover < 0.2 then 'degraded' else 'healthy' end as vector from h) :: select source_id, vector, case when vector in ('unavailable', 'degraded') then 'degraded' else 'healthy' end as overall from v
""")
def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector part's state by its own ladder, and the whole: degraded if any part is."""
    s = F.col("status")
    h = jobs(spark, sf_dir).groupBy("source_id").agg(F.bool_or((s == "failed") & (F.col("attempts") >= 6)).alias("rebuild"), F.count_if(s == "completed").alias("done"), F.count("*").alias("n"))
    vector = ops.vector_state(F.col("rebuild"), F.col("done") > 0, F.when(F.col("done") / F.col("n") < 0.2, "degraded").otherwise("healthy"))
    return h.withColumn("vector", vector).select("source_id", "vector", ops.overall_state("vector").alias("overall"))


@query("""
with q as (select conv_id, list(distinct turn order by turn) filter (where role = 'user') as expected, list(distinct turn order by turn) filter (where turn % 3 <> 1 and role <> 'system') as recalled from conversations group by conv_id) ::
select conv_id, len(list_intersect(coalesce(expected, []), coalesce(recalled, []))) as hits, len(coalesce(expected, [])) as n_expected,
  concat_ws(',', case when len(list_filter(coalesce(recalled, []), lambda x: not list_contains(coalesce(expected, []), x))) > 0 then 'extra_evidence' end,
  case when len(list_intersect(coalesce(expected, []), coalesce(recalled, []))) < len(coalesce(expected, [])) then 'expected_fact_missing' end) as failures from q
""")
def question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled against expected evidence of each question: hits, and why it fails."""
    recalled = F.collect_set(F.when((F.col("turn") % 3 != 1) & (F.col("role") != "system"), F.col("turn")))
    q = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "user", F.col("turn"))).alias("expected"), recalled.alias("recalled"))
    hits, extra = F.size(F.array_intersect("expected", "recalled")), F.size(F.array_except("recalled", "expected"))
    failures = rules.listed([(extra > 0, "extra_evidence"), (hits < F.size("expected"), "expected_fact_missing")])
    return q.select("conv_id", hits.cast("bigint").alias("hits"), F.size("expected").cast("bigint").alias("n_expected"), F.array_join(failures, ",").alias("failures"))


@query("""
with m as (select conv_id, conv_id || ':' || turn as fact, role, turn, text from conversations),
s as (select conv_id, fact, role = 'user' as e, role = 'system' as f, (role = 'user' and length(text) > 40) or (role = 'system' and length(text) % 5 = 0) or (role = 'assistant' and length(text) % 11 = 0) as r, true as known from m
  union all select conv_id, conv_id || ':gone', false, false, true, false from m group by conv_id having sum(length(text)) % 4 = 0),
t as (select conv_id, count(*) filter (where e) as expected, count(*) filter (where e and r) as hits, count(*) filter (where r and not known) as u, count(*) filter (where r and f) as f, count(*) filter (where r and not e) as x, count(*) filter (where e or r) as n from s group by conv_id) ::
select conv_id, expected, hits, case when u > 0 then 'unknown_evidence' when f > 0 then 'forbidden_evidence' when x > 0 then 'extra_evidence' end as error,
  case when u + f + x = 0 and hits < expected then 'expected_fact_missing' end as failure from t where n > 0
""")
def question_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown, forbidden and extra evidence are errors, in this order; what is missing fails a question without errors."""
    m = table(spark, sf_dir, "conversations").select("conv_id", F.concat("conv_id", F.lit(":"), "turn").alias("fact"), "role", F.length("text").alias("n"))
    role, n = F.col("role"), F.col("n")
    lost = m.groupBy("conv_id").agg(F.sum("n").alias("n")).filter("n % 4 = 0").select("conv_id", F.concat("conv_id", F.lit(":gone")).alias("fact"))
    recalled = m.filter(((role == "user") & (n > 40)) | ((role == "system") & (n % 5 == 0)) | ((role == "assistant") & (n % 11 == 0))).select("conv_id", "fact").unionByName(lost)
    return ops.score_questions(m.filter(role == "user"), m.filter(role == "system"), recalled, m, "conv_id", "fact")


@query("""
select count(*) filter (where l.doc_id is null) as missing, (select count(*) from labels x where not exists (select 1 from documents d where d.doc_id = x.doc_id)) as extra, count(*) - count(distinct d.doc_id) as repeated from documents d left join labels l on l.doc_id = d.doc_id
""")
def persistence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected ids that are not stored, stored ones that nobody expects, and ids expected twice."""
    d, s = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    one = d.join(s.withColumn("hit", F.lit(1)), "doc_id", "left").agg(F.count_if(F.col("hit").isNull()).alias("missing"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"))
    return one.crossJoin(F.broadcast(merge.missing(s, d, "doc_id").agg(F.count("*").alias("extra"))))


@query("""
with s as (select source_id, bool_or(status = 'completed') as completed, bool_or(status = 'failed') as failed from jobs where k < 3 group by source_id) ::
select count(*) as attempted, count(*) filter (where completed) as completed, count(*) filter (where failed) as failed, count(*) filter (where completed and not failed) as isolated from s
""")
def corruption_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources were tried, came through, failed, and came through without a failure of their own."""
    s = jobs(spark, sf_dir).filter("k < 3").groupBy("source_id").agg(F.bool_or(F.col("status") == "completed").alias("c"), F.bool_or(F.col("status") == "failed").alias("f"))
    return s.agg(F.count("*").alias("attempted"), F.count_if("c").alias("completed"), F.count_if("f").alias("failed"), F.count_if(F.col("c") & ~F.col("f")).alias("isolated"))


@query("""
with b as (select project, memory_id, strlen('{"memory_id":' || memory_id || ',"title":"' || title || '"}') as n, sha256('{"memory_id":' || memory_id || ',"title":"' || title || '"}') as h from memories where tier = 'core')
:: select project, count(*) as sections, cast(sum(n) as bigint) as size, bit_xor(('0x' || substr(h, 1, 12))::bigint) as digest from b group by project
""")
def context_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of all sections before any bound, and a digest that does not depend on their order, so no payload is gathered."""
    line = F.to_json(F.struct("memory_id", "title"))
    h = F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1, 12), 16, 10).cast("bigint")
    rows = memories(spark, sf_dir).filter("tier = 'core'").select("project", F.octet_length(line).alias("n"), h.alias("h"))
    return rows.groupBy("project").agg(F.count("*").alias("sections"), F.sum("n").cast("bigint").alias("size"), F.bit_xor("h").alias("digest"))


@query("""
select user_id, concat_ws(',', first_a, first_b) as refs from (select user_id, min(event_type) as first_a, case when max(event_type) <>
  min(event_type) then max(event_type) end as first_b from events group by user_id)
""")
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of evidence as one: distinct, not blank, the first list's items first, ten at most."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array(F.min("event_type"), F.lit(" ")).alias("a"), F.array(F.max("event_type"), F.min("event_type")).alias("b"))
    return e.select("user_id", F.array_join(values.distinct_first(F.col("a"), F.col("b")), ",").alias("refs"))


# listings


@query("""
select memory_id, round(weight * 0.35::double + importance * 0.1::double, 4) as score from memories where memory_type = 'decision' order by score
  desc, memory_id limit 10
""")
def top_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten decisions; equal scores keep their order of input."""
    score = F.bround(F.col("weight") * 0.35 + F.col("importance") * 0.1, 4)
    return memories(spark, sf_dir).filter("memory_type = 'decision'").select("memory_id", score.alias("score")).orderBy(F.desc("score"), "memory_id").limit(10)


@query("select memory_id, coalesce(valid_to, valid_from, '') as moment from memories order by moment desc, memory_id desc limit 40")
def distilled_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the time of occurrence, or of the last change where that is missing; as text."""
    at = F.coalesce("valid_to", "valid_from", F.lit(""))
    return memories(spark, sf_dir).select("memory_id", at.alias("moment")).orderBy(F.desc("moment"), F.desc("memory_id")).limit(40)


@query("""
select job_id from jobs where status in ('queued', 'retrying') and job_id not in (select doc_id from documents where doc_id % 2 = 0) order by made_at,
  job_id limit 10
""")
def reconciled_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest pending ones that no decision covers yet."""
    done = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("job_id"))
    return jobs(spark, sf_dir).filter("status in ('queued', 'retrying')").join(done, "job_id", "left_anti").orderBy("made_at", "job_id").limit(10).select("job_id")


@query(f"""
with first_ as (select * from memories where tier = 'core' and review = 'approved' and status = 'active' and privacy in ('private', 'restricted') order by weight desc, importance desc, valid_from desc nulls last, memory_id limit 40) ::
select memory_id, weight, tier from first_ where (scope = '' or scope like '%all%') and contains(project, 'p') and memory_id in (select memory_id from ({_reason_sql("current")}) where reason = 'currently_valid')
""")
def core_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned core memories; the limit comes before scope, project and time."""
    f = retrieval.Filters(privacy=("private", "restricted"), project="p", instant=AS_OF)
    return retrieval.core_list(memories(spark, sf_dir), f, 40, F.col("review") == "approved", F.col("valid_from")).select("memory_id", "weight", "tier")


_EVIDENCE = """
e as (select message_id, content, conversation_id, sequence, case when sequence % 4 = 3 then null else conversation_id * 60 + sequence end as moment from messages where role <> 'system'),
g as (select *, row_number() over (order by moment is null, moment, sequence, conversation_id, message_id) as place, count(*) over () as total from e), p as (select * from g where place > 10 and place <= 40),
s as (select *, coalesce(sum(least(length(content), 4000)) over (order by place rows between unbounded preceding and 1 preceding), 0) as before from p)"""


@query(f"""
with {_EVIDENCE} :: select message_id, length(substr(content, 1, greatest(0, least(4000, 5000 - before))::bigint)) as shown, length(content) >
  greatest(0, least(4000, 5000 - before)) as truncated, total, total > 40 as has_more from s
""")
def evidence_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of evidence by instant, rows without one last, each with what a budget for the page leaves of its content.

    While the budget lasts a row takes the least of its length and 4,000 (here of 5,000 for the page), so what is used before a
    row is a sum over the page, which has 30 rows.
    """
    at = F.when(F.col("sequence") % 4 != 3, F.col("conversation_id") * 60 + F.col("sequence"))
    rows = messages(spark, sf_dir).filter("role <> 'system'").withColumn("at", at)
    order = [F.asc_nulls_last("at"), F.asc("sequence"), F.asc("conversation_id"), F.asc("message_id")]
    page = search.page(rows, order, 30, 10, most=50)
    taken = F.sum(F.least(F.length("content"), F.lit(4000))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    allowed = F.greatest(F.lit(0), F.least(F.lit(4000), 5000 - F.coalesce(taken, F.lit(0)))).cast("int")
    shown = page.withColumn("allowed", allowed)
    return shown.select("message_id", F.length(F.substring(F.col("content"), F.lit(1), F.col("allowed"))).cast("bigint").alias("shown"), (F.length("content") > F.col("allowed")).alias("truncated"), "total", "has_more")
