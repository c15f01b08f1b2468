"""Readers of other records: attachments, strict transcripts, work reports, bundles and session databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.timefns import strict_instant

_FILE = "struct<id:string,file_id:string,asset_pointer:string,name:string,file_name:string,filename:string,mime_type:string,size:string>"
REPORT = "task_id string, execution_id string, project_id string, status string, completed_at string, title string, errors array<string>, decisions array<string>, remaining_tasks array<string>"
#: Sessions of a database that are read, newest first, and characters of a message (fixed values).
MOST_SESSIONS, MOST_CHARS = 2000, 200_000


def attachments(metadata: Column) -> Column:
    """(id, name, mime_type, size) of each file named in a message's metadata, given as JSON; names differ between exports."""
    given = F.from_json(metadata, f"struct<attachments:array<{_FILE}>,files:array<{_FILE}>>")
    listed = F.coalesce(F.when(F.size(given.attachments) > 0, given.attachments), given.files)
    full = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    told = F.transform(listed, lambda f: F.struct(full(f["id"], f.file_id, f.asset_pointer).alias("id"), full(f["name"], f.file_name, f.filename).alias("name"), full(f.mime_type).alias("mime_type"), full(f["size"]).alias("size")))
    return F.coalesce(told, F.array().cast("array<struct<id:string,name:string,mime_type:string,size:string>>"))


def strict_transcript(rows: DataFrame) -> DataFrame:
    """(conversation_id, problem) of conversations that a strict reader refuses; rows: (conversation_id, line_no, message_id,
    sequence, timestamp). No row means that all is well."""
    w = Window.partitionBy("conversation_id").orderBy("line_no")
    at = strict_instant(F.col("timestamp"))
    checked = rows.select("conversation_id", "message_id", (F.lag("sequence").over(w) >= F.col("sequence")).alias("turned"), (F.lag(at).over(w) > at).alias("back"), at.isNull().alias("no_zone"))
    seen = checked.groupBy("conversation_id").agg((F.count("*") - F.count_distinct("message_id")).alias("repeated"), F.bool_or("turned").alias("turned"), F.bool_or("back").alias("back"), F.bool_or("no_zone").alias("no_zone"))
    problem = F.when(F.col("repeated") > 0, "repeated_id").when(F.col("no_zone"), "no_zone").when(F.col("turned"), "order").when(F.col("back"), "time_order")
    return seen.select("conversation_id", problem.alias("problem")).filter("problem is not null")


def _token(c: Column) -> Column:
    """Letters, digits and underscores of a name, other signs as one dash, eighty at most."""
    clean = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.when(clean == "", "UNKNOWN").otherwise(F.left(clean, F.lit(80)))


def work_reports(reports: DataFrame, column: str = "value") -> DataFrame:
    """Documents of work reports, given as JSON: one for the report, and one for each error, decision and remaining task.

    (id, parent, kind, status, title, related): a child's id is a digest of its text, its status is open for errors and
    needs_review for the rest; the parent lists its children, a child its parent.
    """
    r = reports.select(F.from_json(column, REPORT).alias("r")).select("r.*").withColumn("main", F.concat_ws("-", F.lit("REPORT"), _token(F.col("task_id")), _token(F.col("execution_id"))))
    child = lambda kind: lambda x: F.struct(F.lit(kind.lower()).alias("kind"), F.concat_ws("-", F.lit(kind), _token(F.col("task_id")), F.upper(F.left(F.sha2(x.cast("binary"), 256), F.lit(16)))).alias("id"), x.alias("text"))
    none = F.array().cast("array<string>")
    parts = [F.transform(F.coalesce(c, none), child(k)) for c, k in (("errors", "ERROR"), ("decisions", "DECISION"), ("remaining_tasks", "TASK"))]
    told = r.withColumn("children", F.concat(*parts))
    main = told.select(F.col("main").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("work_report").alias("kind"), "status", "title", F.array_join(F.transform("children", lambda x: x.id), ",").alias("related"))
    below = told.select("main", F.explode("children").alias("c")).select(
        F.col("c.id").alias("id"), F.col("main").alias("parent"), F.col("c.kind").alias("kind"), F.when(F.col("c.kind") == "error", "open").otherwise("needs_review").alias("status"),
        F.left("c.text", F.lit(80)).alias("title"), F.col("main").alias("related"),
    )
    return main.unionByName(below)


def session_bundles(files: DataFrame, column: str = "value") -> DataFrame:
    """(session_id, sequence, role, text) of bundles that hold a session's events as one JSON document."""
    b = files.select(F.from_json(column, "session_id string, events array<struct<role:string,text:string>>").alias("b"))
    events = b.select("b.session_id", F.posexplode("b.events").alias("sequence", "e"))
    return events.filter("trim(e.text) <> ''").select("session_id", "sequence", "e.role", "e.text")


def session_database(session: DataFrame, message: DataFrame, part: DataFrame, injected: str = r"^\s*<(system|environment|context)", most: int = MOST_SESSIONS) -> DataFrame:
    """Messages of a session database given as tables: (session_id, sequence, message_id, role, content).

    The newest sessions; parts of type text joined by a line break in order; users and assistants only; texts that a program
    put in are left out; numbers run from 1 in each session. The parts of one message are one row, cut at a fixed length.
    """
    newest = session.orderBy(F.desc("time_updated"), "id").limit(most).select(F.col("id").alias("session_id"))
    role = F.get_json_object("data", "$.role")
    said = message.join(F.broadcast(newest), "session_id", "left_semi").withColumn("role", role).filter(F.col("role").isin("user", "assistant"))
    text = part.filter(F.get_json_object("data", "$.type") == "text").select("message_id", F.col("sequence").alias("_s"), F.col("id").alias("_p"), F.trim(F.get_json_object("data", "$.text")).alias("_t"))
    text = text.filter((F.col("_t") != "") & ~F.col("_t").rlike(injected))
    listed = text.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("_s", "_p", "_t"))).alias("_l"))
    whole = listed.select("message_id", F.left(F.array_join(F.transform("_l", lambda x: x["_t"]), "\n"), F.lit(MOST_CHARS)).alias("content"))
    w = Window.partitionBy("session_id").orderBy("time_created", "message_id")
    rows = said.select("session_id", F.col("id").alias("message_id"), "role", "time_created").join(whole, "message_id")
    return rows.select("session_id", F.row_number().over(w).alias("sequence"), "message_id", "role", "content")


#: Source types, endings and keys of a payload that name a reader, in the order in which they are tried.
READERS = [
    ("chat_export", ["chat_export"], [".zip"], "mapping"), ("history_inbox", ["history_inbox"], [".jsonl"], "conversations"), ("work_report", ["work_report"], [], "task_id"),
    ("session_bundle", ["session_bundle"], [], "events"), ("session_database", ["session_database"], [".db", ".sqlite"], None), ("note", ["note"], [".md"], None),
]


def reader_of(kind: Column, path: Column, payload: Column) -> Column:
    """The reader of a request: by the type it names, else by a key of its payload, else by its path; null where none fits."""
    out = F
    for name, kinds, _, _ in READERS:
        out = out.when(kind.isin(kinds), name)
    for name, _, _, key in READERS:
        out = out.when(F.get_json_object(payload, f"$.{key}").isNotNull(), name) if key else out
    for name, _, ends, _ in READERS:
        for e in ends:
            out = out.when(F.endswith(F.lower(path), F.lit(e)), name)
    return out


def event_lines(lines: DataFrame, schema: str) -> DataFrame:
    """(file, line_no, r) of the lines that are not blank; r is the parsed record, with nulls where a line is broken."""
    return lines.filter(F.trim("value") != "").select("file", "line_no", F.from_json("value", schema).alias("r"))


def zip_entries(archives: DataFrame, ending: str = ".json", most_bytes: int = 256 << 20) -> DataFrame:
    """(path, entry, value) of the entries of zip archives, as spark.read.format("binaryFile") gives these (path, content).

    Entries that do not end as named, folders and entries over `most_bytes` unpacked are left out; a broken archive gives none.
    """

    def unpacked(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for info in z.infolist():
                            if info.filename.lower().endswith(ending) and not info.is_dir() and info.file_size <= most_bytes:
                                yield pa.RecordBatch.from_pydict({"path": [path], "entry": [info.filename], "value": [z.read(info).decode("utf-8", "replace")]})
                except zipfile.BadZipFile:
                    continue

    return archives.select("path", "content").mapInArrow(unpacked, "path string, entry string, value string")
