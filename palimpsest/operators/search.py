"""Lexical, vector and hybrid search over chunks, with the rules that decide which rows stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.textfns import occurrences

#: Weights of a term in each column of a chunk, and the constants of BM25 (fixed values).
WEIGHTS = {"title": 8.0, "heading": 4.0, "text": 1.0, "tags": 2.0}
K1, B = 1.2, 0.75
RRF = 60


def _lowered(chunks: DataFrame) -> DataFrame:
    """The searched columns in lower case, made once; nulls are empty."""
    return chunks.withColumns({f"_{c}": F.lower(F.coalesce(c, F.lit(""))) for c in WEIGHTS})


def lexical(chunks: DataFrame, terms: list[str], allowed: Column | None = None, key: str = "chunk_id", limit: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Chunks that hold every term (in whichever columns), with bm25 and lexical_score, best first.

    Corpus statistics are of all chunks, filtered ones too; they are one aggregate over one scan. Terms under three
    characters match nothing, as with trigrams. With postings (trigram_postings of the same chunks) only chunks that hold all
    trigrams of the terms are read for scoring.
    """
    low = [t.lower() for t in terms]
    if not low or min(map(len, low)) < 3:
        return chunks.filter(F.lit(False)).withColumns({"bm25": F.lit(0.0), "lexical_score": F.lit(0.0)})
    length = sum((F.greatest(F.length(F.coalesce(c, F.lit(""))) - 2, F.lit(0)) for c in WEIGHTS), F.lit(0))

    def holds(t: str) -> Column:
        hit = F.lit(False)
        for c in WEIGHTS:
            hit = hit | F.contains(F.col(f"_{c}"), F.lit(t))
        return hit

    stats = _lowered(chunks).agg(F.count("*").alias("_n"), F.avg(length).alias("_avg"), *(F.count_if(holds(t)).alias(f"_n{i}") for i, t in enumerate(low)))
    hits = chunks.filter(allowed) if allowed is not None else chunks
    if postings is not None:
        hits = hits.join(posted(postings, low, key), key, "left_semi")
    hits = _lowered(hits)
    for t in low:
        hits = hits.filter(holds(t))
    hits = hits.crossJoin(F.broadcast(stats))  # one row of statistics
    total = F.lit(0.0)
    for i, t in enumerate(low):
        tf = sum((w * occurrences(F.col(f"_{c}"), t, lowered=True) for c, w in WEIGHTS.items()), F.lit(0.0))
        raw = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        total = total + F.when(raw <= 0, 1e-6).otherwise(raw) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("_avg")))
    out = hits.withColumn("bm25", -total).withColumn("lexical_score", 1 / (1 + F.abs("bm25")))
    out = out.drop("_n", "_avg", *(f"_n{i}" for i in range(len(low))), *(f"_{c}" for c in WEIGHTS))
    return out.orderBy("bm25", key).limit(limit) if limit else out


def _grams(c: Column) -> Column:
    """Each three characters in a row, joined from the array of characters: substrings by place would be quadratic in length."""
    signs = F.split(c, "")
    after = lambda n: F.slice(signs, F.lit(n + 1), F.greatest(F.size(signs) - n, F.lit(0)))
    three = F.zip_with(F.zip_with(signs, after(1), lambda a, b: F.concat(a, b)), after(2), lambda a, b: F.concat(a, b))
    return F.filter(three, lambda g: F.length(g) == 3)


def trigram_postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(gram, key) of every distinct trigram of every chunk, over its searched columns in lower case: an index to be written
    partitioned or clustered by gram, so that a search reads the grams of its terms only."""
    low = _lowered(chunks).select(key, *(F.col(f"_{c}") for c in WEIGHTS))
    return low.select(F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col(f"_{c}")) for c in WEIGHTS])))).alias("gram"), key)


def posted(postings: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """Keys of chunks that hold all trigrams of all terms; only postings of those grams are read."""
    grams = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
    return postings.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("_g")).filter(F.col("_g") == len(grams)).select(key)


def substring(chunks: DataFrame, pieces: list[str], key: str = "chunk_id", limit: int | None = None) -> DataFrame:
    """Chunks that hold all pieces in their columns together; title hits first."""
    joined = F.lower(F.concat_ws(" ", *WEIGHTS))
    out = chunks
    for p in pieces:
        out = out.filter(F.contains(joined, F.lit(p.lower())))
    first = F.greatest(*[F.contains(F.lower("title"), F.lit(p.lower())).cast("int") for p in pieces], F.lit(0))
    out = out.withColumn("title_hit", first)
    return out.orderBy(F.desc("title_hit"), key).limit(limit) if limit else out


def similarity(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """Score of a vector against a query, in doubles; distances are negated, so that greater is nearer."""
    q = F.array(*[F.lit(float(x)) for x in query])
    fold = lambda f: F.aggregate(F.zip_with(F.transform(vector, lambda x: x.cast("double")), q, f), F.lit(0.0), lambda a, x: a + x)
    dot = fold(lambda x, y: x * y)
    if metric == "dot":
        return dot
    if metric == "euclid":
        return -F.sqrt(fold(lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return -fold(lambda x, y: F.abs(x - y))
    norm = F.sqrt(fold(lambda x, y: x * x)) * F.lit(sum(x * x for x in query) ** 0.5)
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def vector_topk(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest vectors; ties by key."""
    return vectors.select(key, similarity(F.col(column), query, metric).alias("score")).orderBy(F.desc("score"), key).limit(k)


def fuse(channels: dict[str, DataFrame], key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank from 1): sum of 1 / (60 + rank), and the channels of each row."""
    parts = [df.select(key, "rank", F.lit(name).alias("channel")) for name, df in channels.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("channel")).alias("channels"))


def metadata_boost(terms: list[str], project_filter: bool = False, pinned: Column | None = None, semantic: Column | None = None) -> Column:
    """The sum of small rewards for matching terms, tier, importance, recall weight, status, review and authority (fixed values).

    pinned tells rows that are pinned to contexts, by default by their tier; semantic is a score of rows that an earlier fusion
    found by meaning, null for others.
    """
    hits = lambda c, each, most: F.least(sum((F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t)).cast("int") for t in terms), F.lit(0)) * each, F.lit(most))
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return (
        hits("title", 0.025, 0.10) + hits("heading", 0.012, 0.05) + hits("tags", 0.008, 0.03)
        + F.when(F.col("tier") == "core", 0.035).otherwise(0.0) + F.when(F.col("tier") == "pinned" if pinned is None else pinned, 0.025).otherwise(0.0)
        + F.col("importance") * 0.004
        + F.least(F.greatest(weight - 1, F.lit(-0.5)), F.lit(2.0)) * 0.01
        + (0.025 if project_filter else 0.0)
        + F.when(F.col("status") == "active", 0.008).otherwise(0.0)
        + F.when(F.col("review") == "approved", 0.008).otherwise(0.0)
        + F.col("authority") * 0.02
        + (F.lit(0.0) if semantic is None else F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), semantic)) * 0.01, F.lit(0.0)))
    )


def cap_per_memory(ranked: DataFrame, most: int = 3, memory: str = "memory_id", order: list | None = None) -> DataFrame:
    """At most so many rows of a memory, in the order given."""
    w = Window.partitionBy(memory).orderBy(*(order or [F.desc("score"), "chunk_id"]))
    return ranked.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= most).drop("_place")


def resolve_authority(rows: DataFrame, group: list[str], key: str = "conflict_key", rank: str = "authority") -> DataFrame:
    """Hides rows of lower authority within a conflict group; ties at the top stay. Rows without a key are never in conflict.

    The greatest rank of each group is aggregated with map-side combine and joined; rows without a key, however many, take no
    part in that and are not shuffled.
    """
    named = F.trim(F.coalesce(key, F.lit(""))) != ""
    top = rows.filter(named).groupBy(*group, key).agg(F.max(rank).alias("_top"))
    kept = rows.filter(named).join(top, [*group, key]).filter(F.col(rank) >= F.col("_top"))
    return kept.select(*rows.columns).unionByName(rows.filter(~named))


def channel_split(rows: DataFrame, evidence: Column, n: int, order: list) -> DataFrame:
    """The first n rows of each channel, memories before evidence; the place within the whole list is added."""
    split = rows.withColumn("channel", F.when(evidence, "evidence").otherwise("memory"))
    w = Window.partitionBy("channel").orderBy(*order)
    return split.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def scope_visible(scopes: Column, agent: str | None, listing: bool = False) -> Column:
    """Empty scopes are open to all. Without an agent others pass only with 'all' in retrieval, and never in listings."""
    if agent is None:
        return (F.size(scopes) == 0) if listing else (F.size(scopes) == 0) | F.array_contains(scopes, "all")
    return (F.size(scopes) == 0) | F.arrays_overlap(scopes, F.array(F.lit("all"), F.lit(agent)))


def plausible_recall(score: Column, query: Column, content: Column) -> Column:
    """Scores under 0.55 go; a near-perfect one stays only if one text, without outer blanks, holds the other and none is empty."""
    q, c = F.trim(F.coalesce(query, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    return (score >= 0.55) & ((score < 0.999) | ((q != "") & (c != "") & (F.contains(q, c) | F.contains(c, q))))


# conditions that callers put together


def equal_or_any(column: str, wanted: str | None) -> Column:
    """Equality that is no condition when nothing is wanted."""
    return F.lit(True) if wanted in (None, "") else F.col(column) == wanted


def in_or_any(column: str, wanted: list[str]) -> Column:
    """Membership; an empty list is no condition."""
    return F.col(column).isin(wanted) if wanted else F.lit(True)


def in_or_none(column: str, wanted: list[str]) -> Column:
    """Membership; an empty list denies all."""
    return F.col(column).isin(wanted) if wanted else F.lit(False)


def json_member(column: str, wanted: str) -> Column:
    """Whether a JSON list of texts holds one; null and malformed lists hold none."""
    return F.coalesce(F.array_contains(F.from_json(column, "array<string>"), wanted), F.lit(False))


def like_any(columns: list[str], text: str) -> Column:
    """Whether any column holds the text as it is written, without regard to the case of ASCII letters, though of those alone; '%'
    and '_' are no wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.translate(F.coalesce(F.col(c), F.lit("")), upper, lower), F.translate(F.lit(text), upper, lower))
    return hit


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of rows in order, each with the total and whether more follow; a limit outside 1..most is an error."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("offset must be greater than or equal to zero")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def clamped(limit: int, most: int = 50) -> int:
    """A limit of a caller that is bounded instead of refused."""
    return min(max(limit, 1), most)


def authorised(rows: DataFrame, sources: DataFrame, source: str, exempt: Column) -> DataFrame:
    """Rows without an automatic source, exempt ones, and those whose source is authorised now; sources: (source, status)."""
    good = sources.filter(F.lower(F.trim("status")) == "authorized").select(source, F.lit(True).alias("_good")).distinct()
    free = (F.trim(F.coalesce(source, F.lit(""))) == "") | exempt
    governed = rows.filter(~free).join(good, source, "left_semi")
    return rows.filter(free).unionByName(governed.select(*rows.columns))
