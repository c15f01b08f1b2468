"""A corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, near_dedup, packing, substring, toxicity
from palimpsest.llm._shared import materialise
from palimpsest.llm.queries import BYTE_BPE, toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, written once, for decisions that name rows and not ids."""
    return materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that the classifier, learned from labels, scores below 0.5. Null and empty texts are scored like any other,
    repeated rows share a score, other columns are dropped, and an empty table gives an empty one."""
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return toxicity.score(rows, toxicity_model(spark, sf_dir), id_col="row").filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each class of near-duplicates, of repeated rows one. Rows with null texts all stay; null ids
    come last; other columns are dropped; an empty table gives an empty one."""
    rows = _numbered(docs)
    ordered = rows.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row").alias("_id"), "text")
    kept = near_dedup.near_duplicates(ordered, id_col="_id").filter("keep").select(F.col("_id._row").alias("_row"))
    return rows.join(kept, "_row").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words and more that occur earlier; rows of which nothing is left go, others keep their text if nothing was cut.

    Null and empty texts stay as they are; of repeated rows the first keeps its text; other columns are dropped; an empty table
    gives an empty one.
    """
    cut = substring.remove_repeats(docs.select(*COLUMNS), window=20).filter("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    return cut.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, or half of one and more, however many items share what they hold. Null texts hold none;
    repeated rows go or stay together; other columns are dropped; an empty table, or an empty benchmark, drops nothing."""
    rows = _numbered(docs)
    hits = decontaminate.find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row", shared=True).select("_row").distinct()
    return rows.join(hits, "_row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens: one row a piece. A null text is an empty one, which has its end id;
    repeated rows get places of their own; an empty table gives no piece."""
    return packing.pack(packing.tokenize_pieces(docs, public_tokenizers.path(BYTE_BPE), capacity=2048, with_ids=False), capacity=2048)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeats), ("decontamination", drop_contaminated), ("packing", pack)]

#: Tokenizers and trained models have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
