"""Readers of conversation archives: history inboxes, chat exports, transcripts, notes and web pages, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.timefns import strict_instant

MESSAGE = "message_id string, role string, content string, timestamp string"
HISTORY = f"schema string, schema_version string, conversations array<struct<conversation_id string, title string, messages array<struct<{MESSAGE.replace(' string', ':string').replace(', ', ',')}>>>>"
PARTS = "struct<id:string,author:struct<role:string,name:string>,content:struct<parts:array<string>,text:string,result:string>,create_time:double>"
EXPORT = f"id string, title string, current_node string, create_time double, mapping map<string,struct<parent:string,message:{PARTS}>>"


def strip(c: Column) -> Column:
    """Without blanks and line breaks at either end."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def inbox_messages(read: DataFrame) -> DataFrame:
    """One row a message of parsed inbox files: conversation, title, position, and the message's fields."""
    conv = read.select(F.explode("conversations").alias("c"))
    return conv.select("c.conversation_id", "c.title", F.posexplode("c.messages").alias("sequence", "m")).select("conversation_id", "title", "sequence", "m.*")


def history_json(spark: SparkSession, path: str) -> DataFrame:
    """Messages of inbox files, each one JSON document."""
    return inbox_messages(spark.read.schema(HISTORY).json(path, multiLine=True))


def history_jsonl(lines: DataFrame) -> DataFrame:
    """Messages of typed JSON lines; lines: (file, line_no, value). A message needs its conversation's line earlier in the file.

    valid is false where that line is missing, the time has no zone or runs backwards, or an id is not unique in its file.
    """
    record = F.from_json("value", f"type string, conversation_id string, title string, {MESSAGE}").alias("r")
    rows = lines.select("file", "line_no", record).select("file", "line_no", "r.*")
    head = rows.filter("type = 'conversation'").groupBy("file", "conversation_id").agg(F.min("line_no").alias("_at"), F.min_by("title", "line_no").alias("_title"), F.count("*").alias("_heads"))
    said = rows.filter("type = 'message'").drop("title", "type").join(head, ["file", "conversation_id"], "left")
    w = Window.partitionBy("file", "conversation_id").orderBy("line_no")
    alone = F.count("*").over(Window.partitionBy("file", "message_id")) == 1
    at = strict_instant(F.col("timestamp"))
    ordered = said.withColumn("sequence", F.row_number().over(w) - 1).withColumn("_at_time", at).withColumn("_before", F.lag(at).over(w)).withColumn("_alone", alone)
    fine = F.col("_at").isNotNull() & (F.col("_at") < F.col("line_no")) & (F.col("_heads") == 1) & F.col("_alone") & F.col("_at_time").isNotNull()
    fine = fine & (F.col("_before").isNull() | (F.col("_before") <= F.col("_at_time")))
    return ordered.select("file", "conversation_id", F.col("_title").alias("title"), "sequence", "message_id", "role", "content", "timestamp", F.coalesce(fine, F.lit(False)).alias("valid"))


def history_markdown(files: DataFrame) -> DataFrame:
    """Messages of Markdown archives; files: (path, value). Blocks start with '## role | time | id'."""
    head = lambda k: F.trim(F.regexp_extract("value", rf"(?m)^{k}:\s*(.+)$", 1))
    block = r"(?ms)^## ([^|\n]+)\|([^|\n]+)\|([^\n]+)\n(.*?)(?=^## [^|\n]+\|[^|\n]+\||\z)"
    parts = [F.regexp_extract_all("value", F.lit(block), i) for i in (1, 2, 3, 4)]
    return (
        files.select("path", head("conversation_id").alias("conversation_id"), head("title").alias("title"), F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abcd", strict=True)])).alias("sequence", "b"))
        .select("path", "conversation_id", "title", "sequence", *(strip(F.col(f"b.{c}")).alias(n) for c, n in zip("abcd", ["role", "timestamp", "message_id", "content"], strict=True)))
    )


def flatten_parts(content: Column) -> Column:
    """Text of a message: its parts with a blank line between them, or else its text or result."""
    parts = F.array_join(F.filter(content.parts, lambda p: F.trim(p) != ""), "\n\n")
    return F.coalesce(F.when(parts != "", parts), content.text, content.result, F.lit(""))


def chat_export(exports: DataFrame) -> DataFrame:
    """Messages of node maps, in order of time and node; on_path tells the current branch from others.

    exports has the columns of EXPORT. The path from the current node to the root is walked inside each row's own map,
    at most as many steps as it has nodes, so a cycle ends. Messages are in order of time, without one first, then of position.
    """
    walk = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size("mapping"), F.lit(1))),
        F.struct(F.col("current_node").alias("at"), F.array().cast("array<string>").alias("path")),
        lambda a, _: F.struct(F.when(a.at.isNotNull() & ~F.array_contains(a.path, F.coalesce(a.at, F.lit(""))), F.element_at("mapping", a.at).parent).alias("at"), F.when(a.at.isNotNull() & ~F.array_contains(a.path, F.coalesce(a.at, F.lit(""))), F.array_append(a.path, a.at)).otherwise(a.path).alias("path")),
        lambda a: a.path,
    )
    entries = exports.withColumn("_path", walk).select("id", "title", "_path", F.posexplode(F.map_entries("mapping")).alias("_pos", "e"))
    nodes = entries.select("id", "title", "_path", "_pos", F.col("e.key").alias("node"), F.col("e.value").alias("v")).filter("v.message is not null")
    w = Window.partitionBy("id").orderBy(F.coalesce("v.message.create_time", F.lit(0.0)), "_pos")
    return nodes.select(
        F.col("id").alias("conversation_id"), "title", (F.row_number().over(w) - 1).alias("sequence"), "node", F.col("v.message.author.role").alias("role"),
        flatten_parts(F.col("v.message.content")).alias("content"), F.timestamp_micros((F.col("v.message.create_time") * 1000000).cast("bigint")).alias("at"), F.array_contains("_path", F.col("node")).alias("on_path"),
    )


#: Longest line of a transcript that is read; longer ones are a program's own data (fixed value).
LONGEST_LINE = 8 << 20


def first_seen(rows: DataFrame, group: str, order: str, names: list[str]) -> DataFrame:
    """Rows of which no name was seen on a row kept earlier in the group; a row that goes does not hide later ones.

    Rows whose names are all unique in their group stay at once. Only the rest, its names alone, is walked in order, group by
    group; a group is one file.
    """
    long = rows.select(group, order, F.explode(F.array_distinct(F.array(*names))).alias("_name"))
    repeated = long.groupBy(group, "_name").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    walked = long.join(repeated, [group, "_name"], "left_semi").groupBy(group, order).agg(F.collect_list("_name").alias("names"))

    def walk(part):
        seen: set[str] = set()
        gone = []
        for at, found in zip(*(part.sort_values(order)[c] for c in (order, "names")), strict=True):
            if seen.isdisjoint(found):
                seen.update(found)
            else:
                gone.append(at)
        return part[part[order].isin(gone)][[group, order]]

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (group, order))
    return rows.join(walked.groupBy(group).applyInPandas(walk, kinds), [group, order], "left_anti")


def rollout(lines: DataFrame) -> DataFrame:
    """Messages of session transcripts; lines: (file, line_no, value). Bad and overlong lines are skipped; the first session line
    of a file names it. A message whose id, or whose role, text and time, was kept before goes. Messages without a zone are
    dropped, and numbers run from 0 again."""
    record = F.from_json("value", "type string, timestamp string, payload struct<id:string,role:string,text:string>")
    rows = lines.filter(F.octet_length("value") <= LONGEST_LINE).withColumn("r", record).filter(F.col("r.type").isNotNull())
    session = rows.filter("r.type = 'session' and r.payload.id <> ''").groupBy("file").agg(F.min_by("r.payload.id", "line_no").alias("session_id"))
    said = rows.filter("r.type = 'message'").filter(F.col("r.timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$")).select("file", "line_no", F.col("r.timestamp").alias("timestamp"), "r.payload.*")
    digest = F.sha2(F.concat_ws("|", "role", "text", "timestamp").cast("binary"), 256)
    named = said.withColumn("_digest", digest).withColumn("_id", F.coalesce(F.nullif("id", F.lit("")), "_digest"))
    once = first_seen(named, "file", "line_no", ["_id", "_digest"])
    order = Window.partitionBy("file").orderBy("line_no")
    return once.join(session, "file", "left").select("file", "session_id", (F.row_number().over(order) - 1).alias("sequence"), "id", "role", "text", "timestamp")


def front_matter(text: Column, key: str) -> Column:
    """A scalar of the front matter between the first two '---' lines."""
    head = F.regexp_extract(text, r"\A\x{FEFF}?---\r?\n(?s:(.*?))\r?\n---\r?\n?", 1)
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1)), r"^['\"]|['\"]$", ""), F.lit(""))


def front_matter_list(text: Column, key: str) -> Column:
    """A list of the front matter, written in brackets or as lines with a dash; a scalar is a list of itself."""
    head = F.regexp_extract(text, r"\A\x{FEFF}?---\r?\n(?s:(.*?))\r?\n---\r?\n?", 1)
    flow, lines = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1), F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1)
    bare = lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")
    dashed = F.transform(F.filter(F.split(lines, r"\n"), lambda x: F.trim(x) != ""), lambda x: bare(F.regexp_replace(x, r"^[ \t]*-[ \t]*", "")))
    one = front_matter(text, key)
    return F.when(flow != "", F.transform(F.split(flow, ","), bare)).when(lines != "", dashed).when(one.isNotNull() & (one != "[]"), F.array(one)).otherwise(F.array().cast("array<string>"))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\x{FEFF}?---\r?\n(?s:.*?)\r?\n---\r?\n?", "")


def notes(files: DataFrame) -> DataFrame:
    """Notes with front matter; files: (path, value). The summary is the first line of more than 20 characters, cut at 300."""
    lines = F.filter(F.transform(F.split(body(F.col("value")), "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & ~x.startswith("#"))
    names = ["id", "title", "memory_type", "memory_tier", "status", "privacy", "valid_from", "valid_to"]
    return files.select("path", *(front_matter(F.col("value"), n).alias(n) for n in names), body(F.col("value")).alias("body"), F.substring(F.get(lines, F.lit(0)), 1, 300).alias("summary"), F.sha2(body(F.col("value")).cast("binary"), 256).alias("body_hash"))


_BLOCKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote|pre)\b[^>]*>"
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def page_text(html: Column) -> Column:
    """Readable text: scripts, styles and comments go, block tags break lines, other tags go, blanks collapse."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCKS, "\n"), r"(?s)<[^>]*>", "")
    for name, sign in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t\x{00A0}]+", " "), r"\s*\n\s*", "\n"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def page_charset(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?is)<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([^\s"'/>;]+)""", 1))


def page_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), 1))


#: Elements that are not text, and those that hold what a page says (fixed values).
HIDDEN = ["script", "style", "noscript", "svg", "canvas"]
SPOKEN = ["p", "article", "section", "main", "h1", "h2", "h3", "h4", "li", "blockquote", "pre"]


def _unescaped(c: Column) -> Column:
    for name, sign in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def spoken_text(html: Column) -> Column:
    """What a page says: the text from the start of a speaking element to the next end of one, a line for each such end.

    Two signs that no text holds stand for starts and ends; what is left of the page then is split at ends, and each part is
    what follows its first start. Elements that are not text and comments go first, other tags count as blanks.
    """
    gone = "|".join([*(rf"<{t}\b.*?</{t}\s*>" for t in HIDDEN), "<!--.*?-->"])
    text = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), "\x01\x02", "  "), f"(?is){gone}", " ")
    tags = "|".join(SPOKEN)
    text = F.regexp_replace(F.regexp_replace(text, rf"(?is)</(?:{tags})\b[^>]*>", "\x02"), rf"(?is)<(?:{tags})\b[^>]*>", "\x01")
    text = _unescaped(F.regexp_replace(text, "(?s)<[^>]*>", " "))
    said = F.transform(F.split(text, "\x02"), lambda x: F.when(F.contains(x, F.lit("\x01")), F.regexp_replace(F.regexp_replace(x, "(?s)^[^\x01]*", ""), r"[\x01\s\x{00A0}]+", " ")).otherwise(F.lit("")))
    return strip(F.regexp_replace(F.array_join(said, "\n"), r" *\n\s*", "\n"))
