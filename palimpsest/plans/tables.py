"""Stand-ins for memories, messages, jobs and sources, made from the test tables; the same derivations as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.timefns import micros

#: Each derived column as an expression that Spark and DuckDB read alike.
MEMORY = {
    "memory_id": "doc_id", "chunk_id": "doc_id", "title": "source", "heading": "lang", "text": "text", "tags": "lang || ' ' || source",
    "memory_type": "case when doc_id % 3 = 0 then 'decision' when doc_id % 3 = 1 then 'knowledge' else 'preference' end",
    "tier": "case when doc_id % 9 = 0 then 'core' when doc_id % 9 = 1 then 'pinned' else 'normal' end",
    "status": "case when doc_id % 7 = 0 then 'superseded' when doc_id % 11 = 0 then 'archived' when doc_id % 13 = 0 then '' else 'active' end",
    "privacy": "case when doc_id % 5 = 0 then 'restricted' else 'private' end",
    "review": "case when doc_id % 2 = 0 then 'approved' else '' end",
    "importance": "cast(doc_id % 5 as int)", "weight": "cast(doc_id % 4 as double) / 2", "authority": "cast((doc_id % 6) * 10 as int)",
    "project": "'p' || cast(doc_id % 8 as varchar(9))",
    "conflict_key": "case when doc_id % 4 = 0 then '' else 'k' || cast(doc_id % 10 as varchar(9)) end",
    "valid_from": "case when doc_id % 17 = 0 then '2026-01-01T00:00:00' when doc_id % 19 = 0 then null else '2026-01-' || lpad(cast(doc_id % 28 + 1 as varchar(9)), 2, '0') || 'T00:00:00Z' end",
    "valid_to": "case when doc_id % 3 = 0 then '2026-02-' || lpad(cast(doc_id % 28 + 1 as varchar(9)), 2, '0') || 'T00:00:00+00:00' when doc_id % 23 = 0 then 'soon' else null end",
    "scope": "case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then 'all' when doc_id % 4 = 2 then 'a1' else 'a2,all' end",
}
#: Pieces of documents of PIECE characters, several a memory; derived and evidence rows, and a time of change.
PIECE = 400
CHUNK = MEMORY | {
    "chunk_id": "doc_id * 100000 + part", "heading": "lang || cast(part % 3 as varchar(9))", "text": f"substr(text, cast(part * {PIECE} + 1 as int), {PIECE})",
    "memory_type": "case when doc_id % 4 = 3 then 'structured_evidence' when doc_id % 3 = 0 then 'decision' else 'knowledge' end",
    "tier": "case when doc_id % 9 = 0 then 'core' when doc_id % 9 = 1 then 'pinned' when doc_id % 9 < 4 then 'derived' else 'normal' end",
    "status": "case when doc_id % 7 = 0 then 'superseded' when doc_id % 11 = 0 then 'archived' when doc_id % 5 = 2 then 'needs_review' else 'active' end",
    "updated": "'2026-01-' || lpad(cast(doc_id % 28 + 1 as varchar(9)), 2, '0')",
}
MESSAGE = {
    "conversation_id": "conv_id", "sequence": "turn", "message_id": "cast(conv_id as varchar(20)) || ':' || cast(turn as varchar(20))", "role": "role", "content": "text",
    "source_id": "'s' || cast(conv_id % 5 as varchar(9))", "made_at": "conv_id * 1000 + turn",
}
JOB = {
    "job_id": "event_id", "path": "'inbox/' || cast(user_id as varchar(20)) || '.json'", "scan": "'scan-' || cast(user_id % 10 as varchar(9))", "source_id": "'s' || cast(user_id % 20 as varchar(9))",
    "status": "case event_type when 'signup' then 'queued' when 'error' then 'failed' when 'click' then 'running' when 'view' then 'completed' else 'retrying' end",
    "attempts": "cast(event_id % 6 + 1 as int)", "priority": "cast(event_id % 3 as int)", "stage": "event_type", "value": "value",
    "retryable": "event_id % 4 = 0", "reason": "case when event_id % 5 = 0 then 'HTTP 401 Unauthorized at line ' || cast(event_id as varchar(20)) when event_id % 5 = 1 then 'disk full after ' || cast(event_id as varchar(20)) || ' bytes' when event_id % 5 = 2 then '' else 'Timeout ' || cast(event_id % 30 as varchar(9)) || ' s' end",
}


def _sql(columns: dict[str, str], table: str, more: str = "") -> str:
    return f"select {', '.join(f'{e} as {n}' for n, e in columns.items())}{more} from {table}"


#: Common table expressions for the oracle.
CTE = {
    "memories": _sql(MEMORY, "documents"),
    "chunks": _sql(CHUNK, f"(select *, unnest(range(cast(greatest(ceil(length(text) / {PIECE}.0), 1) as bigint))) as part from documents)"),
    "messages": _sql(MESSAGE, "conversations"),
    "jobs": _sql(JOB, "events", ", cast(json_extract(props, '$.k') as bigint) as k, epoch_us(ts) as made_at"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} as {n}" for n, e in MEMORY.items())).withColumn("scopes", F.filter(F.split("scope", ","), lambda x: x != ""))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / F.lit(float(PIECE))), F.lit(1)).cast("bigint") - 1)
    rows = table(spark, sf_dir, "documents").withColumn("part", F.explode(parts)).selectExpr(*(f"{e} as {n}" for n, e in CHUNK.items()))
    return rows.withColumn("scopes", F.filter(F.split("scope", ","), lambda x: x != ""))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*(f"{e} as {n}" for n, e in MESSAGE.items()))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = micros(F.col("ts"))
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} as {n}" for n, e in JOB.items()), "cast(get_json_object(props, '$.k') as bigint) as k", "ts").withColumn("made_at", at).drop("ts")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt over all cores where its files have fewer splits than that; larger tables stay as they are read.

    df must be a scan with filters and columns only, for its splits are told from its plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
