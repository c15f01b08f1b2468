"""Operator 13: mix sources to target weights by weighted fair queueing.

Documents of a source stand in a shuffled queue, over again in each further copy of the source. A document's virtual finish time
is the number of its source's words up to its end divided by the source's weight. Served at equal virtual time, sources give words
in proportion to their weights until one has been taken `most` times whole; the others go on. The mix is what finishes, in the
order of finish times, until the budget is spent. The document that a source is serving then is cut there, so each source gives
its target to the word. Queues and the mix are ordered by range sorts, with running totals over ranges (operators.ranges), so
neither a source nor the mix is ever in one task. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import materialise
from palimpsest.operators.ranges import running

#: One word with the blanks after it; possessive, so that Java's matcher never steps back.
_WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def word_count(text: Column) -> Column:
    """Runs without the six ASCII blanks. Each word becomes one letter, so a long text needs no array of its words."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]++", ""), _WORD, "x")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), percent: int = 100, most: int = 3) -> DataFrame:
    """(source, source_size, weight, base, target) of each source of sized (source, size).

    Sources in order of code points, null last, get the weights in turn and share percent of all words by weight, none more than
    `most` times its size; what one cannot take the others share by weight, as far as all together can. base is the size of all
    earlier sources. Sorted by the virtual time at which a source is used up, `most` times size by weight, the budget left at each
    by the weight left is a virtual time; the latest of these is when the budget is spent.
    """
    groups = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = running(groups, [F.col("source").asc_nulls_last()], {"base": F.col("source_size")}, "nth").withColumn("weight", turn.cast("long"))
    bounded = sources.withColumn("bound", F.col("source_size") * most).withColumn("used_up", F.col("bound") / F.col("weight"))
    queue = running(bounded, [F.col("used_up"), F.col("nth")], {"bound_before": F.col("bound"), "weight_before": F.col("weight")})
    sums = sources.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("all_weight"))
    budget = F.floor(F.col("all") * percent / 100).cast("long")
    level = (budget - F.col("bound_before")).cast("double") / (F.col("all_weight") - F.col("weight_before"))
    timed = queue.crossJoin(F.broadcast(sums)).withColumn("budget", budget).withColumn("level", level)
    end = timed.agg(F.max("level").alias("end"))
    target = F.least(F.col("bound").cast("double"), F.col("weight") * F.col("end"))
    return timed.crossJoin(F.broadcast(end)).select("source", "source_size", "weight", "base", "budget", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), percent: int = 100, most: int = 3, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: a row for each copy of a document that may be in it, in columns id, source, size, source_size, target, row, copy,
    finish (virtual time), words (how many of its first words the mix takes; 0 where it is beyond the end) and position (words of
    the mix before it).

    Every row of docs has at least its first copy here; `row` numbers rows of docs, so repeated ids stay apart. Null texts have
    size 0, rows without a source are a source of their own. Rows equal in source, id and size are alike, so reruns agree. An
    empty table gives no rows. If percent is above 100 times `most`, all of each source is taken `most` times.
    """
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    sources = materialise(source_targets(sized, weights, percent, most), "sources")
    shuffled = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    queue = running(sized.withColumn("_hash", shuffled), [F.col("source").asc_nulls_last(), F.col("_hash"), F.col("doc_id"), F.col("size")], {"_all": F.col("size")}, "row").drop("_hash")
    told = queue.join(F.broadcast(sources) if _few(sources) else sources, queue["source"].eqNullSafe(sources["source"])).drop(sources["source"])

    goal = F.ceil("target").cast("long")
    copies = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(goal / F.greatest("source_size", F.lit(1))))).cast("int")
    start = F.col("_all") - F.col("base") + (F.col("copy") - 1) * F.col("source_size")
    served = F.greatest(F.lit(0), F.least("size", F.col("goal") - F.col("start")))
    entries = (
        told.withColumn("goal", goal).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("start", start).withColumn("words", served)
        .withColumn("finish", (F.col("start") + F.greatest("words", F.lit(0))) / F.col("weight"))
    )
    served_in_order = running(entries, [F.col("finish"), F.col("source").asc_nulls_last(), F.col("start"), F.col("row")], {"position": F.col("words")})
    left = F.greatest(F.lit(0), F.least("words", F.col("budget") - F.col("position")))
    return served_in_order.withColumn("words", left.cast("long")).select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "row", F.col("copy").cast("int").alias("copy"), "finish", "words", "position"
    )


#: Sources whose row is sent to every task; more are joined by a shuffle.
FEW_SOURCES = 10_000


def _few(sources: DataFrame) -> bool:
    return sources.count() <= FEW_SOURCES


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each row that mix was given: id, size, source_size, target and the words that the mix takes of it over all copies."""
    return mixed.groupBy("row", id_col, "size", "source_size", "target").agg(F.sum("words").alias("taken")).drop("row")
