"""Readers over archives that are made from the tables, and writes as new states of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import merge, writes
from palimpsest.plans.registry import query
from palimpsest.plans.tables import jobs, memories, messages, table
from palimpsest.sources import history, records

# readers: the archives are JSON or Markdown made of whole tables, one file a conversation


def _stamp(c):
    return F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) + c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


_STAMP = "strftime(make_timestamp((1767225600 + {c})::bigint * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


@query(f"""
select 'c' || conversation_id as conversation_id, role, content, sequence, {_STAMP.format(c='sequence')} as timestamp from messages where content <>
  ''
""")
def inbox_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History inboxes of one JSON document a conversation. Only rows of a conversation are gathered to make its file."""
    m = messages(spark, sf_dir).filter("content <> ''")
    one = F.struct("sequence", F.struct("message_id", "role", "content", _stamp(F.col("sequence")).alias("timestamp")).alias("m"))
    conv = m.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.m).alias("messages"))
    said = F.array(F.struct(F.concat(F.lit("c"), "conversation_id").alias("conversation_id"), F.lit("t").alias("title"), "messages"))
    files = conv.select(F.to_json(F.struct(F.lit("x").alias("schema"), F.lit("1").alias("schema_version"), said.alias("conversations"))).alias("value"))
    read = history.inbox_messages(files.select(F.from_json("value", history.HISTORY).alias("r")).select("r.*"))
    return read.select("conversation_id", "role", "content", F.element_at(F.split("message_id", ":"), 2).cast("bigint").alias("sequence"), "timestamp")


_LINES = """
l as (select conversation_id as f, sequence, message_id, case when sequence % 5 = 4 then message_id || 'x' when sequence = 3 then conversation_id || ':2' else message_id end as id,
  case when sequence = 1 and conversation_id % 7 = 0 then '2026-01-01T00:00:09' else strftime(make_timestamp((1767225600 + case when conversation_id % 6 = 0 and sequence = 5 then 0 else sequence end)::bigint * 1000000), '%Y-%m-%dT%H:%M:%SZ') end as at,
  conversation_id % 4 > 0 as headed from messages)"""


@query(f"""
with {_LINES}, t as (select *, try_cast(case when "at" like '%Z' then "at" end as timestamptz) as t, count(*) over (partition by f, id) as n from l),
b as (select *, lag(t) over (partition by f order by sequence) as before from t) ::
select id as message_id, sequence, coalesce(headed and n = 1 and t is not null and (before is null or before <= t), false) as valid from b
""")
def inbox_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed JSON lines with repeated ids, times without zone or turned back, and files without the line of their conversation."""
    c, s = F.col("conversation_id"), F.col("sequence")
    at = F.when((s == 1) & (c % 7 == 0), "2026-01-01T00:00:09").otherwise(_stamp(F.when((c % 6 == 0) & (s == 5), 0).otherwise(s)))
    ident = F.when(s % 5 == 4, F.concat("message_id", F.lit("x"))).when(s == 3, F.concat(c.cast("string"), F.lit(":2"))).otherwise(F.col("message_id"))
    m = messages(spark, sf_dir)
    said = m.select(c.cast("string").alias("file"), (s + 1).alias("line_no"), F.to_json(F.struct(F.lit("message").alias("type"), c.cast("string").alias("conversation_id"), ident.alias("message_id"), at.alias("timestamp"))).alias("value"))
    heads = m.filter(c % 4 > 0).select(c.cast("string").alias("file"), F.lit(0).cast("bigint").alias("line_no"), F.to_json(F.struct(F.lit("conversation").alias("type"), c.cast("string").alias("conversation_id"), F.lit("t").alias("title"))).alias("value")).distinct()
    return history.history_jsonl(said.unionByName(heads)).select("message_id", F.col("sequence").cast("bigint").alias("sequence"), "valid")


@query("""
select conversation_id, row_number() over (partition by conversation_id order by sequence) - 1 as sequence, role, message_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) as content from messages
""")
def inbox_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown archives: front matter, then a block for each message."""
    text = F.trim(F.regexp_replace("content", r"\s+", " "))
    block = F.concat(F.lit("## "), "role", F.lit(" | "), _stamp(F.col("sequence")), F.lit(" | "), "message_id", F.lit("\n"), text, F.lit("\n\n"))
    conv = messages(spark, sf_dir).groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", block.alias("b")))), lambda x: x.b), "").alias("body"))
    value = F.concat(F.lit("---\nconversation_id: "), F.col("conversation_id").cast("string"), F.lit("\ntitle: t\n---\n"), "body")
    read = history.history_markdown(conv.select(F.col("conversation_id").cast("string").alias("path"), value.alias("value")))
    return read.select(F.col("conversation_id").cast("bigint").alias("conversation_id"), F.col("sequence").cast("bigint").alias("sequence"), "role", "message_id", "content")


@query("""
with n as (select *, max(sequence) over (partition by conversation_id) as last, min(sequence) over (partition by conversation_id) as first from messages) ::
select conversation_id, message_id as node, row_number() over (partition by conversation_id order by case when sequence % 4 = 2 then 0 else sequence + 1 end, sequence) - 1 as sequence, role, content, sequence = first or sequence <> 1 as on_path from n where not (last = 1 and sequence = 1 and false)
""")
def chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat exports as node maps: the second message of each is a branch that the current path leaves out, some have no time."""
    s = F.col("sequence")
    m = messages(spark, sf_dir)
    parent = F.when(s == 1, F.concat("conversation_id", F.lit(":0"))).when(s == 2, F.concat("conversation_id", F.lit(":0"))).otherwise(F.concat("conversation_id", F.lit(":"), s - 1))
    node = F.struct(
        parent.alias("parent"),
        F.struct(F.col("message_id").alias("id"), F.struct("role").alias("author"), F.struct(F.array("content").alias("parts")).alias("content"), F.when(s % 4 != 2, (s + 1).cast("double")).alias("create_time")).alias("message"),
    )
    entry = F.struct("sequence", F.struct(F.col("message_id").alias("key"), node.alias("value")).alias("e"))
    conv = m.groupBy("conversation_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.e)).alias("mapping"), F.max_by("message_id", s).alias("current_node"))
    files = conv.select(F.to_json(F.struct(F.col("conversation_id").cast("string").alias("id"), F.lit("t").alias("title"), "current_node", "mapping")).alias("v"))
    read = history.chat_export(files.select(F.from_json("v", history.EXPORT).alias("r")).select("r.*"))
    single = m.groupBy("conversation_id").agg(F.max("sequence").alias("last"))
    shown = read.withColumn("conversation_id", F.col("conversation_id").cast("bigint")).join(single, "conversation_id")
    fine = F.col("on_path") & ~((F.col("last") == 1) & F.endswith("node", F.lit(":1")))
    return shown.select("conversation_id", "node", F.col("sequence").cast("bigint").alias("sequence"), "role", "content", fine.alias("on_path"))


@query("""
with r as (select conversation_id, sequence, message_id, role from messages where sequence % 6 <> 5), k as (
  select * from r where not (sequence = 4 and exists (select 1 from r x where x.conversation_id = r.conversation_id and x.sequence = 2))
    and not (sequence = 3 and exists (select 1 from r x where x.conversation_id = r.conversation_id and x.sequence = 1))) ::
select conversation_id, message_id, row_number() over (partition by conversation_id order by sequence) - 1 as sequence from k
""")
def transcript_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with a repeated id, a repeated content, broken lines and times without a zone.

    The fourth message has the second one's id, the fifth the third one's role, text and time; every sixth has no zone.
    """
    s, c = F.col("sequence"), F.col("conversation_id")
    m = messages(spark, sf_dir)
    ident = F.when(s == 3, F.concat(c.cast("string"), F.lit(":1"))).otherwise(F.col("message_id"))
    text = F.when(s.isin(2, 4), "same").otherwise(F.concat(F.lit("m"), s.cast("string")))
    at = F.when(s % 6 == 5, "2026-01-01T00:00:00").otherwise(_stamp(F.when(s == 4, 2).otherwise(s)))
    role = F.when(s.isin(2, 4), "user").otherwise(F.col("role"))
    said = F.to_json(F.struct(F.lit("message").alias("type"), at.alias("timestamp"), F.struct(ident.alias("id"), role.alias("role"), text.alias("text")).alias("payload")))
    lines = m.select(c.cast("string").alias("file"), (2 * s + 1).alias("line_no"), said.alias("value"))
    broken = m.select(c.cast("string").alias("file"), (2 * s + 2).alias("line_no"), F.lit("{broken").alias("value"))
    head = m.select(c.cast("string").alias("file"), F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit('{"type":"session","payload":{"id":"s'), c.cast("string"), F.lit('"}}')).alias("value")).distinct()
    read = history.rollout(lines.union(broken).union(head))
    return read.select(F.substring("session_id", 2, 20).cast("bigint").alias("conversation_id"), F.col("id").alias("message_id"), F.col("sequence").cast("bigint").alias("sequence"))


@query("""
with r as (select conversation_id, count(*) as n, bool_or(sequence = 3) as three, bool_or(sequence = 2) as two, bool_or(sequence = 1) as one from messages group by conversation_id) ::
select conversation_id, case when three and two and conversation_id % 5 = 0 then 'repeated_id' when one and conversation_id % 5 = 1 then 'no_zone' when two and conversation_id % 5 = 2 then 'order' else 'time_order' end as problem from r
where (three and two and conversation_id % 5 = 0) or (one and conversation_id % 5 = 1) or (two and conversation_id % 5 = 2) or (two and conversation_id % 5 = 3)
""")
def transcript_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict reader refuses: repeated ids, no zone, numbers or times that do not ascend."""
    c, s = F.col("conversation_id"), F.col("sequence")
    ident = F.when((c % 5 == 0) & (s == 3), F.concat(c.cast("string"), F.lit(":2"))).otherwise(F.col("message_id"))
    at = F.when((c % 5 == 1) & (s == 1), "2026-01-01T00:00:00").otherwise(_stamp(F.when((c % 5 == 3) & (s == 2), -5).otherwise(s)))
    number = F.when((c % 5 == 2) & (s == 2), 0).otherwise(s)
    rows = messages(spark, sf_dir).select("conversation_id", s.alias("line_no"), ident.alias("message_id"), number.alias("sequence"), at.alias("timestamp"))
    return records.strict_transcript(rows)


@query("""
with d as (select event_id, 'REPORT-t-' || user_id || '-e' || event_id as main, event_type, user_id from events where event_id % 10 = 0),
c as (select main, 'error' as kind, 'ERROR-t-' || user_id || '-' || upper(substr(sha256('failed ' || event_id), 1, 16)) as id, 'failed ' || event_id as text, 1 as o from d
  union all select main, 'decision', 'DECISION-t-' || user_id || '-' || upper(substr(sha256(event_type), 1, 16)), event_type, 2 from d
  union all select main, 'task', 'TASK-t-' || user_id || '-' || upper(substr(sha256('next ' || event_id), 1, 16)), 'next ' || event_id, 3 from d) ::
select main as id, cast(null as varchar) as parent, 'work_report' as kind, 'done' as status, 'R' || event_id as title, (select string_agg(id, ',' order by o) from c where c.main = d.main) as related from d
union all select id, main, kind, case when kind = 'error' then 'open' else 'needs_review' end, text, main from c
""")
def work_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    report = F.struct(
        F.concat(F.lit("t "), u).alias("task_id"), F.concat(F.lit("e"), i).alias("execution_id"), F.lit("done").alias("status"), F.concat(F.lit("R"), i).alias("title"),
        F.array(F.concat(F.lit("failed "), i)).alias("errors"), F.array("event_type").alias("decisions"), F.array(F.concat(F.lit("next "), i)).alias("remaining_tasks"),
    )
    return records.work_reports(table(spark, sf_dir, "events").filter("event_id % 10 = 0").select(F.to_json(report).alias("value")))


@query("""
select 's' || user_id as session_id, row_number() over (partition by user_id order by event_id) - 1 as sequence, event_type as role, 'v' || event_id
  as text from events
""")
def session_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.struct("event_id", F.struct(F.col("event_type").alias("role"), F.concat(F.lit("v"), "event_id").alias("text")).alias("e"))
    b = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(event)), lambda x: x.e).alias("events"))
    files = b.select(F.to_json(F.struct(F.concat(F.lit("s"), "user_id").alias("session_id"), "events")).alias("value"))
    return records.session_bundles(files).withColumn("sequence", F.col("sequence").cast("bigint"))


@query("""
with s as (select conversation_id, max(sequence) as t from messages group by 1 order by t desc, 's' || conversation_id limit 60) ::
select 's' || conversation_id as session_id, cast(row_number() over (partition by conversation_id order by sequence, message_id) as bigint) as sequence, message_id, role, 'a' || sequence || chr(10) || 'b' as content from messages join s using (conversation_id) where role in ('user', 'assistant')
""")
def session_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session database as tables: two text parts a message, others that are no text or that a program put in."""
    m = messages(spark, sf_dir).withColumn("session_id", F.concat(F.lit("s"), "conversation_id"))
    session = m.groupBy(F.col("session_id").alias("id")).agg(F.max("sequence").alias("time_updated"))
    message = m.select(F.col("message_id").alias("id"), "session_id", F.col("sequence").alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    body = lambda kind, text: F.to_json(F.struct(F.lit(kind).alias("type"), text.alias("text")))
    texts = [(2, "text", F.lit("b")), (1, "text", F.concat(F.lit("a"), "sequence")), (3, "tool", F.lit("x")), (4, "text", F.lit(" <system>no</system>"))]
    parts = [m.select("message_id", F.concat("message_id", F.lit(f"/{n}")).alias("id"), F.lit(n).alias("sequence"), body(kind, t).alias("data")) for n, kind, t in texts]
    part = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return records.session_database(session, message, part, most=60).withColumn("sequence", F.col("sequence").cast("bigint"))


@query("""
select doc_id, case doc_id % 4 when 0 then 'f' || doc_id || '|a.txt||3' when 1 then 'p' || doc_id || '|b.pdf|x/y|' when 2 then '' else '' end as files from documents
""")
def attachment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"attachments":[{"file_id":"f'), i, F.lit('","file_name":"a.txt","size":3}]}')))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"attachments":[],"files":[{"id":"","asset_pointer":"p'), i, F.lit('","name":"b.pdf","mime_type":"x/y"}]}'))).when(F.col("doc_id") % 4 == 2, "{}")
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", records.attachments(text).alias("a"))
    return rows.select("doc_id", F.array_join(F.transform("a", lambda x: F.concat_ws("|", x["id"], x["name"], x.mime_type, x["size"])), ",").alias("files"))


@query("""
select event_id, case event_id % 7 when 0 then 'note' when 1 then 'work_report' when 2 then 'history_inbox' when 3 then 'chat_export' when 4 then 'session_database' when 5 then 'session_bundle' end as reader from events
""")
def reader_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the named type, else by the payload, else by the path."""
    i = F.col("event_id") % 7
    kind = F.when(i == 0, "note").otherwise("")
    payload = F.when(i.isin(0, 1), '{"task_id":"x"}').when(i == 5, '{"events":[]}').otherwise("{}")
    path = F.when(i.isin(1, 2), "a/b.JSONL").when(i == 3, "x.zip").when(i == 4, "y.db").otherwise("z.bin")
    return table(spark, sf_dir, "events").select("event_id", records.reader_of(kind, path, payload).alias("reader"))


@query("""
select memory_id, string_agg(message_id, ',' order by sequence) as chunks from memories join messages on conversation_id = memory_id where memory_id
  in (3, 17, 41) group by memory_id
""")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few documents by id, each with its chunks in order; what is read is a few rows."""
    d = memories(spark, sf_dir).filter(F.col("memory_id").isin(3, 17, 41)).select("memory_id")
    c = messages(spark, sf_dir).filter(F.col("conversation_id").isin(3, 17, 41)).select(F.col("conversation_id").alias("memory_id"), "sequence", "message_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "message_id"))), lambda x: x.message_id)
    return d.join(c, "memory_id").groupBy("memory_id").agg(F.array_join(listed, ",").alias("chunks"))


@query("""
select d.memory_id, d.title, m.message_id from memories d join messages m on m.conversation_id = d.memory_id order by d.memory_id, m.sequence
""")
def scan_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with their document, in a stable order made by a range exchange."""
    d = memories(spark, sf_dir).select("memory_id", "title")
    m = messages(spark, sf_dir).select(F.col("conversation_id").alias("memory_id"), "sequence", "message_id")
    return d.join(m, "memory_id").orderBy("memory_id", "sequence").select("memory_id", "title", "message_id")


# writes


@query("""
with o as (select memory_id as id, memory_id as created, title from memories where review = 'approved'), n as (select memory_id as id, memory_id + 5000 as created, tags as title, row_number() over (order by memory_id) + 99 as ordinal from memories where privacy = 'private') ::
select coalesce(n.id, o.id) as id, coalesce(o.created, n.created) as created, case when n.id is null then o.title else n.title end as title, case when n.id is null then -1 else n.ordinal end as ordinal from o full join n on n.id = o.id
""")
def bundle_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    old = rows.filter("review = 'approved'").select(F.col("memory_id").alias("id"), F.col("memory_id").alias("created"), "title", F.lit(-1).cast("bigint").alias("ordinal"))
    new = rows.filter("privacy = 'private'").select(F.col("memory_id").alias("id"), (F.col("memory_id") + 5000).alias("created"), F.col("tags").alias("title"))
    return writes.bundle_upsert(old, new, "id", F.col("id"), ["id"], 100)


@query("""
select memory_id, title from memories where tier = 'normal' union all select memory_id, 'again ' || heading from memories where tier <> 'normal' and
  status = 'active'
""")
def rebuild_keeps_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild drops and makes anew what comes from notes; evidence rows stay."""
    rows = memories(spark, sf_dir).select("memory_id", "title", "tier")
    made = memories(spark, sf_dir).filter("status = 'active'").select("memory_id", F.concat(F.lit("again "), "heading").alias("title"), "tier")
    return writes.rebuild(rows, made, "memory_id", F.col("tier") == "normal").select("memory_id", "title")


@query("""
with o as (select message_id as m, conversation_id % 50 as d, 1 as c from messages where role <> 'system'), n as (select message_id as m, conversation_id % 50 as d, 2 as c from messages where sequence % 2 = 0),
u as (select coalesce(n.m, o.m) as m, coalesce(n.d, o.d) as d, coalesce(n.c, o.c) as c from o full join n on n.m = o.m and n.d = o.d) :: select m, d, c from u where m not in (select message_id from messages where sequence = 5)
""")
def link_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by both ends: new ones replace old ones, then some are taken away."""
    m = messages(spark, sf_dir).select("message_id", "role", "sequence", (F.col("conversation_id") % 50).alias("d"))
    old = m.filter("role <> 'system'").select(F.col("message_id").alias("m"), "d", F.lit(1).alias("c"))
    new = m.filter("sequence % 2 = 0").select(F.col("message_id").alias("m"), "d", F.lit(2).alias("c"))
    return writes.unlink(merge.upsert(old, new, ["m", "d"]), m.filter("sequence = 5").select(F.col("message_id").alias("m")), ["m"])


@query("""
select conversation_id, count(*) as expected, count(*) filter (where role <> 'system') as found, count(*) = count(*) filter (where role <> 'system')
  as verified from messages group by conversation_id
""")
def link_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return writes.verify_links(m.select("conversation_id", "message_id"), m.filter("role <> 'system'").select("message_id"), "conversation_id", ["message_id"])


_STATES = """
p as (select conversation_id as k, case conversation_id % 4 when 0 then 'prepared' when 1 then 'active' else 'received' end as state, case when conversation_id % 9 = 0 then 'remove' else '' end as wanted from messages group by conversation_id),
d as (select conversation_id as k, count(*) as d from messages where role = 'system' and sequence > 0 group by conversation_id)"""


@query(f"""
with {_STATES} :: select p.k, case when wanted = 'remove' then 'removed' when state in ('prepared', 'active') then case when coalesce(d, 0) = 0 then
  'active' else 'repair_required' end else state end as state from p left join d using (k)
""")
def projection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared projections become active if their evidence and their links are the same sets."""
    m = messages(spark, sf_dir).select(F.col("conversation_id").alias("k"), F.col("message_id").alias("r"), "role", "sequence")
    i = F.col("k") % 4
    p = m.select("k").distinct().select("k", F.when(i == 0, "prepared").when(i == 1, "active").otherwise("received").alias("state"), F.when(F.col("k") % 9 == 0, "remove").otherwise("").alias("wanted"))
    return writes.project_states(p, m, m.filter("role <> 'system' or sequence = 0"), "k", "r")


@query("""
with o as (select title as k, max(memory_id) as version, max(authority) % 30 as authority from memories where tier = 'core' group by title), n as (select title as k, max(memory_id) as version, min(authority) + 10 as authority from memories where tier = 'pinned' group by title),
j as (select n.*, o.authority is null or n.authority >= o.authority as ok from n left join o using (k)) ::
select o.k, o.version, case when j.ok then 'superseded' else 'active' end as state, case when j.ok then 200 end as until from o left join j on j.k = o.k union all select k, version, 'active', null from j where ok
""")
def decision_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New decisions close old ones of their key, unless their authority is lower."""
    rows = memories(spark, sf_dir).withColumnRenamed("title", "k")
    own = [F.lit("active").alias("state"), F.lit(None).cast("int").alias("until")]
    old = rows.filter("tier = 'core'").groupBy("k").agg(F.max("memory_id").alias("version"), (F.max("authority") % 30).alias("authority")).select("k", "version", "authority", F.lit(100).alias("since"), *own)
    new = rows.filter("tier = 'pinned'").groupBy("k").agg(F.max("memory_id").alias("version"), (F.min("authority") + 10).alias("authority")).select("k", "version", "authority", F.lit(200).alias("since"), *own)
    return writes.supersede(old, new, "k").select("k", "version", "state", "until")


@query("""
with n as (select title as k, memory_id as version, authority from memories where tier = 'pinned'), o as (select title as k, max(memory_id) as version, max(authority) % 30 as authority from memories where tier = 'core' group by title),
j as (select n.*, greatest(o.authority, max(n.authority) over (partition by n.k order by n.version rows between unbounded preceding and 1 preceding)) as most from n left join o using (k)),
t as (select k, version, lead(version) over (partition by k order by version) as until from j where most is null or authority >= most) ::
select o.k, o.version, case when f.k is null then 'active' else 'superseded' end as state, f.until from o left join (select k, min(version) as until from t group by k) f on f.k = o.k
union all select k, version, case when until is null then 'active' else 'superseded' end, until from t
""")
def decisions_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several new decisions of a key, one after another: each closes the one before, and one of lower authority is refused."""
    rows = memories(spark, sf_dir).withColumnRenamed("title", "k")
    own = [F.lit("active").alias("state"), F.lit(None).cast("bigint").alias("until")]
    old = rows.filter("tier = 'core'").groupBy("k").agg(F.max("memory_id").alias("version"), (F.max("authority") % 30).alias("authority")).select("k", "version", "authority", F.lit(-1).cast("bigint").alias("since"), *own)
    new = rows.filter("tier = 'pinned'").select("k", F.col("memory_id").alias("version"), "authority", F.col("memory_id").alias("since"), *own)
    return writes.supersede(old, new, "k").select("k", "version", "state", "until")


@query("""
with u as (select vec_id, label from embeddings where vec_id % 2 = 1 union all select vec_id, label + 100 from embeddings where vec_id % 2 = 0) ::
  select vec_id, cast(label as bigint) as label from u where vec_id not in (select doc_id from documents where source = 'src3')
""")
def vector_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points replaced by id, then those of some memories deleted."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    new = e.filter("vec_id % 2 = 0").withColumn("label", F.col("label") + 100)
    gone = table(spark, sf_dir, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("vec_id"))
    return writes.delete(merge.replace_rows(e, new, "vec_id"), gone, "vec_id")


@query("select memory_id, status = 'archived' as in_history from memories where status <> 'superseded'")
def archive_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived rows move to the history; superseded ones are removed by id; the rest stays."""
    rows = memories(spark, sf_dir).select("memory_id", "status")
    left = writes.delete(rows, rows.filter("status = 'superseded'"), "memory_id")
    past, rest = writes.archive(left, F.col("status") == "archived", F.lit("2026-01-01T00:00:00Z"))
    return past.select("memory_id", F.lit(True).alias("in_history")).unionByName(rest.select("memory_id", F.lit(False).alias("in_history")))


@query("""
select distinct 'card-' || lower(title) as card, title from memories where title not in (select title from memories where memory_id < 40 and tier =
  'core')
""")
def opportunity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards are written once by the slug of their title."""
    from palimpsest.functions.values import slug

    made = memories(spark, sf_dir).select(F.concat(F.lit("card-"), slug(F.col("title"))).alias("card"), "title")
    log = memories(spark, sf_dir).filter("memory_id < 40 and tier = 'core'").select(F.concat(F.lit("card-"), slug(F.col("title"))).alias("card"))
    return merge.record_once(log, made, "card")


_FILES = """
a as (select 'n/' || memory_id as path, length(text) as size, importance as modified from memories where memory_type <> 'decision'),
b as (select 'n/' || memory_id as path, length(text) + case when weight > 1 then 1 else 0 end as size, case when tier = 'core' then 9 else importance end as modified from memories where status <> 'archived')"""


@query(f"""
with {_FILES} :: select coalesce(a.path, b.path) as path, case when b.path is null then 'removed' when a.path is null then 'added' when a.size =
  b.size and a.modified = b.modified then 'unchanged' else 'updated' end as change from a full join b on a.path = b.path
""")
def note_index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes are read anew only where their size or time changed."""
    rows = memories(spark, sf_dir).withColumn("path", F.concat(F.lit("n/"), "memory_id"))
    old = rows.filter("memory_type <> 'decision'").select("path", F.length("text").alias("size"), F.col("importance").alias("modified"))
    now = rows.filter("status <> 'archived'").select("path", (F.length("text") + F.when(F.col("weight") > 1, 1).otherwise(0)).alias("size"), F.when(F.col("tier") == "core", 9).otherwise(F.col("importance")).alias("modified"))
    return writes.index_by_stat(old, now)


@query("""
with a as (select chunk_id, title || heading as f from memories where memory_type <> 'decision'), b as (select chunk_id, case when tier = 'core' then title else title || heading end as f from memories where status <> 'archived') ::
select coalesce(a.chunk_id, b.chunk_id) as chunk_id, case when b.chunk_id is null then 'delete' else 'upsert' end as call from a full join b on a.chunk_id = b.chunk_id where a.chunk_id is null or b.chunk_id is null or a.f <> b.f
""")
def vector_coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that bring vectors in step with chunks, by fingerprint."""
    rows = memories(spark, sf_dir)
    a = rows.filter("memory_type <> 'decision'").select("chunk_id", F.concat("title", "heading").alias("f"))
    b = rows.filter("status <> 'archived'").select("chunk_id", F.when(F.col("tier") == "core", F.col("title")).otherwise(F.concat("title", "heading")).alias("f"))
    return writes.coordinate(a, b, "chunk_id", "f")


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: case when vec_id % 13 = 0 then 0 else x::double end) as e from embeddings), n as (select vec_id, list_sum(list_transform(e, lambda x: x * x)) as n2 from v) ::
select doc_id, case when n2 is null then 'missing' else 'degenerate' end as why from documents left join n on vec_id = doc_id where n2 is null or n2 < 1e-12
""")
def vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must be embedded again: rows without a vector, and those whose vector has no length."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.aggregate(F.transform("embedding", lambda x: F.when(F.col("vec_id") % 13 == 0, 0.0).otherwise(x.cast("double"))), F.lit(0.0), lambda a, x: a + x * x).alias("n2"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id", "left").filter("n2 is null or n2 < 1e-12")
    return rows.select("doc_id", F.when(F.col("n2").isNull(), "missing").otherwise("degenerate").alias("why"))


@query("select count(*) as n, max(event_id) as watermark, count(distinct user_id) as sessions from events where event_id > 9000")
def watermark_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a step above a stored watermark takes on, and the next watermark."""
    return table(spark, sf_dir, "events").filter("event_id > 9000").agg(F.count("*").alias("n"), F.max("event_id").alias("watermark"), F.count_distinct("user_id").alias("sessions"))


@query("""
select job_id, case when source_id not in ('s1', 's2', 's3') and status in ('queued', 'running') then 'failed' else status end as status from jobs
""")
def revoked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running scans of sources that are revoked or unknown fail."""
    s = spark.createDataFrame([(f"s{k}", "authorized" if k < 4 else "revoked") for k in range(1, 15)], "source_id string, status string")
    return writes.revoke_running(jobs(spark, sf_dir).select("job_id", "source_id", "status"), s, "source_id").select("job_id", "status")
