"""Operational analytics: queues, failures, facts, coverage, integrity, evaluation, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import merge
from palimpsest.operators.containment import containing
from palimpsest.operators.ranges import deal

JOB_STATUSES = ["queued", "running", "retrying", "completed", "failed"]
#: Points of review findings and the levels of their capped sum (fixed values).
LEVELS = [(90, "critical"), (60, "high"), (25, "medium")]


def status_counts(rows: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """A count for every status listed, zero where there is no row."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(s,) for s in statuses], f"{column} string")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(listed).join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def pivot_counts(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """One column of counts for each value; written as conditional counts, so one shuffle."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def failures(rows: DataFrame, key: list[str], keep: int = 5, id_col: str = "id") -> DataFrame:
    """Count, first and last time, most attempts and the `keep` least distinct ids of each group of failures.

    Ids are limited by their rank, which Spark cuts within each task before the shuffle, so a group however large sends at most
    `keep` of them from a task and no array grows with it.
    """
    figures = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("made_at").alias("first_at"), F.max("made_at").alias("last_at"), F.max("attempts").alias("max_attempts")
    )
    place = F.dense_rank().over(Window.partitionBy(*key).orderBy(id_col))
    least = rows.select(*key, id_col).withColumn("_place", place).filter(F.col("_place") <= keep).select(*key, id_col).distinct()
    listed = least.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.col(id_col))).cast("array<string>"), ",").alias("ids"))
    return figures.join(listed, key)


def collapse(rows: DataFrame, per: str, order: list[str]) -> DataFrame:
    """The earliest row of each group, with the number of rows merged into it."""
    rest = [c for c in rows.columns if c != per]
    return rows.groupBy(per).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"), (F.count("*") - 1).alias("merged")).select(per, "_first.*", "merged")


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(expected, indexed, missing, ratio) in one row; the ratio of an empty expectation is 1."""
    joined = expected.select(key).distinct().join(found.select(F.col(key), F.lit(1).alias("_hit")).distinct(), key, "left")
    return joined.agg(F.count("*").alias("expected"), F.count("_hit").alias("indexed")).select(
        "expected", "indexed", (F.col("expected") - F.col("indexed")).alias("missing"),
        F.when(F.col("expected") == 0, 1.0).otherwise(F.round(F.col("indexed") / F.col("expected"), 6)).alias("ratio"),
    )


def contiguity(rows: DataFrame, group: str, ordinal: str, first: int = 0) -> DataFrame:
    """Whether each group's ordinals are first, first + 1, ... without gaps, repeats or nulls."""
    n = F.count("*")
    fine = (F.min(ordinal) == first) & (F.max(ordinal) == n - 1 + first) & (F.count_distinct(ordinal) == n) & (F.count(ordinal) == n)
    return rows.groupBy(group).agg(n.alias("n"), fine.alias("contiguous"))


def indexed_percentile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """The element at int(n * q) of all values in order, not an interpolated one.

    Values are counted first, and the running count over distinct ones is made in two levels, so no task orders them all.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"))
    upto = merge.running_total(counts, F.col(value), [value], "_c", "_before").crossJoin(F.broadcast(total))
    return upto.filter(F.col("_before") + F.col("_c") > F.floor(F.col("_n") * q)).agg(F.min(value).alias("value"))


def capped_risk(points: Column) -> tuple[Column, Column]:
    """The sum of an array of points, 100 at most, and its level."""
    score = F.least(F.lit(100), F.aggregate(points, F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0)))).cast("int")
    level = F
    for least, name in LEVELS:
        level = level.when(score >= least, name)
    return score, level.otherwise("low")


def owner_routing(reason: Column, retryable: Column, rules: list[tuple[list[str], str]]) -> Column:
    """Who must act: the system while a retry is possible; else the first rule with a word in the reason names a hint."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    out = F.when(retryable, "system")
    for words, hint in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, f"owner:{hint}")
    return out.otherwise("system")


def decision_score(score: Column, speed: Column, difficulty: Column, profile: bool = True) -> Column:
    """Weighted sum of score, speed, ease and match with a profile, rounded half to even to four places (fixed weights)."""
    bonus = F.when(speed == "fast", 0.3).when(speed == "mid", 0.2).when(speed == "slow", 0.1).otherwise(0.0)
    ease = F.greatest(F.lit(0.0), 1 - (difficulty - 1) * 0.15)
    match = F.when(difficulty <= 2, 0.85).when(difficulty <= 3, 0.65).otherwise(0.35) if profile else F.lit(0.5)
    return F.bround(score * 0.35 + bonus * 0.25 + ease * 0.15 + match * 0.25, 4)


def value_gate(messages: DataFrame, conversation: str, text: str, min_turns: int, min_chars: int, signal: str) -> DataFrame:
    """Turns, characters and a verdict of each conversation: rejected only if short on both and without a signal."""
    said = messages.filter(F.coalesce(text, F.lit("")) != "")
    stats = said.groupBy(conversation).agg(F.count("*").alias("turns"), F.sum(F.length(text)).cast("bigint").alias("chars"), F.bool_or(F.col(text).rlike(signal)).alias("signal"))
    return stats.withColumn("approved", ~((F.col("turns") < min_turns) & (F.col("chars") < min_chars) & ~F.col("signal")))


def hash_chain_breaks(rows: DataFrame, per: list[str], order: list[str], own: str, previous: str) -> DataFrame:
    """Rows whose stored previous hash is not the hash of the row before them."""
    before = F.lag(own).over(Window.partitionBy(*per).orderBy(*order))
    return rows.withColumn("_before", before).filter(~F.col(previous).eqNullSafe(F.col("_before"))).drop("_before")


def unique_resolution(alternatives: list[DataFrame], ref: str, target: str) -> DataFrame:
    """References that exactly one target answers to, over several ways of matching; ambiguous ones are told apart."""
    both = alternatives[0]
    for a in alternatives[1:]:
        both = both.unionByName(a)
    return both.distinct().groupBy(ref).agg(F.count("*").alias("n"), F.min(target).alias(target)).select(ref, F.when(F.col("n") == 1, F.col(target)).alias(target), F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("outcome"))


def contained_passages(docs: DataFrame, items: DataFrame, item: str, passage: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8 << 20) -> DataFrame:
    """(item, id) of every passage that a text contains, as it is written, word bounds or not. Empty passages are in every text.

    Passages of seven words and more meet texts through their second to sixth word, which stand between blanks in the text too,
    wherever the passage begins: a hash join on those five words, broadcast while the passages are few. Only ids and hashes are
    exploded; texts come back for the pairs found. Shorter passages are found by automata over blocks of a bounded size, which
    read each text once a block.
    """
    words = lambda c: F.split(F.translate(c, "\n", " "), " ")
    cut = items.select(item, passage, words(passage).alias("_w"))
    long = cut.filter(F.size("_w") >= 7).select(item, passage, F.xxhash64(*[F.get("_w", F.lit(k)) for k in range(1, 6)]).alias("_key"))
    short = cut.filter(F.size("_w") < 7).select(item, passage)
    sizes = items.agg(F.sum(F.length(passage)).alias("n"), F.count("*").alias("m")).first()
    small = (sizes.n or 0) + 64 * sizes.m <= block_chars
    read = docs.select(id_col, text_col)
    split = read.withColumn("_w", words(text_col))
    near = F.arrays_zip(*[F.slice("_w", k, F.greatest(F.size("_w") - 4, F.lit(0))).alias(f"w{k}") for k in range(1, 6)])
    runs = split.select(id_col, F.explode(F.array_distinct(F.transform(near, lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(1, 6)])))).alias("_key"))
    side = F.broadcast(long) if small else long
    pairs = runs.join(side, "_key").select(id_col, item, passage).distinct()
    exact = pairs.join(read, id_col).filter(F.contains(F.col(text_col), F.col(passage))).select(item, id_col)
    return exact.unionByName(containing(read, short, id_col, text_col, item, passage)).distinct()


def pack_parity(rows: DataFrame, per: str, key: str, order: str, also: str) -> DataFrame:
    """Two parities of a pack with rows (per, key): whether ordering by (order, key) gives the order by key, and whether the rows
    marked `also` are all. Orders agree exactly where `order` never falls along the key; no list of a group is made.

    The greatest `order` before a row is taken in ranges of the key first, so that no group is one task's.
    """
    ranges = deal(rows, [F.col(key), F.col(per)])
    tops = ranges.groupBy(per, "_range").agg(F.min(order).alias("least"), F.max(order).alias("top"))
    before = F.max("top").over(Window.partitionBy(per).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    crossed = tops.withColumn("_b", before).groupBy(per).agg(F.bool_or(F.coalesce(F.col("_b") > F.col("least"), F.lit(False))).alias("crossed"))
    last = F.lag(order).over(Window.partitionBy(per, "_range").orderBy(key))
    inside = ranges.withColumn("_l", last).groupBy(per).agg(F.bool_or(F.coalesce(F.col("_l") > F.col(order), F.lit(False))).alias("inside"), F.bool_and(also).alias("all_also"))
    both = crossed.join(inside, per)
    return both.select(per, F.when(F.col("crossed") | F.col("inside"), "order").otherwise("equal").alias("by_order"), F.when(F.col("all_also"), "equal").otherwise("length").alias("by_rule"))


def vector_state(rebuild: Column, ready: Column, coverage: Column) -> Column:
    """State of a vector index: a due rebuild comes before a missing one, then its coverage decides."""
    return F.when(rebuild, "degraded").when(~ready, "unavailable").when(coverage.isin("degraded", "unavailable"), coverage).otherwise("healthy")


def overall_state(*parts: str) -> Column:
    """healthy only if every part is; one that is degraded or unavailable degrades the whole."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | F.col(p).isin("degraded", "unavailable")
    return F.when(bad, "degraded").otherwise("healthy")


def score_questions(expected: DataFrame, forbidden: DataFrame, recalled: DataFrame, facts: DataFrame, question: str, fact: str) -> DataFrame:
    """(question, expected, hits, error, failure) of each question that expects or recalls something.

    Evidence that no fact of the corpus stands for is an error, then forbidden evidence, then evidence that was not expected: the
    first of these is told and nothing else counts. Otherwise a question fails if a fact that it expects is missing. All are
    sets of (question, fact), compared by one grouping, and facts of the corpus are joined by their own key.
    """
    marked = [df.select(question, fact, *(F.lit(name == n).alias(n) for n in "efr")).distinct() for name, df in (("e", expected), ("f", forbidden), ("r", recalled))]
    sets = marked[0].unionByName(marked[1]).unionByName(marked[2]).groupBy(question, fact).agg(*(F.bool_or(n).alias(n) for n in "efr"))
    known = sets.join(facts.select(fact, F.lit(True).alias("_known")).distinct(), fact, "left")
    r = F.col("r")
    told = known.groupBy(question).agg(
        F.count_if(F.col("e")).alias("expected"), F.count_if(r & F.col("e")).alias("hits"), F.count_if(r & F.col("_known").isNull()).alias("_u"),
        F.count_if(r & F.col("f")).alias("_f"), F.count_if(r & ~F.col("e")).alias("_x"), F.count_if(F.col("e") | r).alias("_n"),
    )
    error = F.when(F.col("_u") > 0, "unknown_evidence").when(F.col("_f") > 0, "forbidden_evidence").when(F.col("_x") > 0, "extra_evidence")
    failure = F.when(error.isNull() & (F.col("hits") < F.col("expected")), "expected_fact_missing")
    return told.filter("_n > 0").select(question, "expected", "hits", error.alias("error"), failure.alias("failure"))
