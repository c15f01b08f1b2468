"""One search call: terms, both channels, fusion, rules on what may be shown, fallback, explanation, citation; and packs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from palimpsest.functions.timefns import validity_reason
from palimpsest.operators import search
from palimpsest.operators.ivf import VectorIndex
from palimpsest.operators.lexical_index import LexicalIndex

#: Candidates per channel for each row wanted, and their least number; ends of fused rounding (fixed values).
OVERFETCH, LEAST_CANDIDATES, PLACES = 6, 30, 8
SHOWN = ["currently_valid", "valid_at_requested_time", "history_requested"]
_TOKEN = re.compile(r"[A-Za-z0-9_.+-]+|[一-鿿]+")


@dataclass(frozen=True)
class Filters:
    """What a caller may see and wants to see. Empty types and statuses are no condition; empty privacy denies all."""

    types: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ("active", "needs_review", "received")
    privacy: tuple[str, ...] = ("public", "private")
    project: str = ""
    tags: tuple[str, ...] = ()
    agent: str | None = None
    mode: str = "current"
    instant: str = ""
    terms: tuple[str, ...] = field(default=(), compare=False)

    def reason(self) -> Column:
        """Why a row is in or out of the view in time."""
        at = F.to_timestamp(F.lit(self.instant)) if self.instant else F.current_timestamp()
        return validity_reason(F.col("status"), F.col("valid_from"), F.col("valid_to"), "current" if self.mode == "why" else self.mode, at)

    def stored(self) -> Column:
        """What the index itself is asked for: types, statuses (of current views only) and privacy."""
        fine = search.in_or_any("memory_type", list(self.types)) & search.in_or_none("privacy", list(self.privacy))
        return fine & search.in_or_any("status", list(self.statuses)) if self.mode in ("current", "why") else fine

    def shown(self) -> Column:
        """Whether the view in time has a row; current views leave out derived rows that are not active."""
        fine = self.reason().isin(SHOWN)
        derived = (F.coalesce(F.col("tier"), F.lit("")) == "derived") & (F.coalesce(F.col("status"), F.lit("")) != "active")
        return fine & ~derived if self.mode in ("current", "why") else fine

    def passes(self) -> Column:
        """What is checked after candidates are ranked: all of the above, scope, project as a piece of text, tags and time."""
        tags = F.transform(F.split("tags", " "), F.lower)
        wanted = F.array(*[F.lit(t.lower()) for t in self.tags]).cast("array<string>")
        fine = self.stored() & search.scope_visible(F.col("scopes"), self.agent) & (F.size(F.array_except(wanted, tags)) == 0)
        fine = fine & F.contains(F.lower("project"), F.lit(self.project.lower())) if self.project else fine
        return fine & self.reason().isin(SHOWN)


def expression(query: str) -> list[str]:
    """Words of a query that trigrams can find; where all are too short, the whole query as one phrase."""
    clean = " ".join(query.split())
    words = [w for w in clean.replace('"', " ").split() if len(w) >= 3]
    return words or ([clean] if clean else [])


def short_terms(query: str) -> bool:
    return any(len(t) < 3 for t in _TOKEN.findall(query))


def pieces(query: str, most: int = 4) -> list[str]:
    """Pieces for a substring search: words, and of a run of ideographs its first and last two and, if long, all of it."""
    out: list[str] = []
    for token in _TOKEN.findall(query):
        if token[0] < "一":
            cut = [token]
        else:
            cut = [token] if len(token) <= 2 else [token[:2], token[-2:], *([token] if len(token) > 4 else [])]
        out += [p for p in cut if p.lower() not in map(str.lower, out)]
    return out[:most]


def marked_snippet(text: Column, terms: list[str], words: int = 22) -> Column:
    """The words around the first hit with every hit in brackets; an ellipsis where text was left out."""
    hit = "|".join(rf"\Q{t}\E" for t in terms)
    split = F.split(F.coalesce(text, F.lit("")), r"\s+")
    first = F.coalesce(F.array_position(F.transform(split, lambda w: w.rlike(f"(?i){hit}")), True), F.lit(0)).cast("int")
    begin = F.greatest(F.lit(1), first - words // 2)
    shown = F.regexp_replace(F.array_join(F.slice(split, begin, F.lit(words)), " "), f"(?i)({hit})", "[$1]")
    return F.concat(F.when(begin > 1, "…").otherwise(""), shown, F.when(begin + words <= F.size(split), "…").otherwise(""))


def cleaned(hits: DataFrame, least: float = 0.0, column: str = "score") -> DataFrame:
    """Hits with a finite score of at least `least`, clamped to 0..1."""
    s = F.col(column)
    fine = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))) & (s >= least)
    return hits.filter(fine).withColumn(column, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def citation(source: list[str]) -> Column:
    """Where a row is from: memory, heading, lines, and what provenance it has, as JSON without the keys that are null."""
    return F.to_json(F.struct("memory_id", "heading", *source))


@dataclass(frozen=True)
class Archive:
    """Chunks with all their columns, and where a search has its candidates from: lexical(terms, limit, allowed) gives rows (key,
    bm25), near(vector, limit) rows (key, score), both best first. evidence tells which rows are shown after all others."""

    chunks: DataFrame
    lexical: Callable[[list[str], int, Column], list[Row]]
    near: Callable[[list[float], int], list[Row]]
    key: str = "chunk_id"
    memory: str = "memory_id"
    evidence: Column | None = None
    least: float = 0.0

    def keyed(self, keys: list) -> DataFrame:
        """The chunks of a top-k list of keys."""
        return self.chunks.filter(F.col(self.key).isin(list(keys)))

    def is_evidence(self) -> Column:
        return F.col("memory_type") == "structured_evidence" if self.evidence is None else self.evidence


def scanned(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", vector_key: str = "vec_id", **more) -> Archive:
    """An archive without indexes: each search scans chunks and vectors."""
    lexical = lambda terms, limit, allowed: search.lexical(chunks, terms, allowed, key, limit).select(key, "bm25").collect()
    near = lambda vector, limit: search.vector_topk(vectors, vector, limit, key=vector_key).collect()
    return Archive(chunks, lexical, near, key, **more)


def indexed(chunks: DataFrame, words: LexicalIndex, vectors: VectorIndex, prove: bool = False, key: str = "chunk_id", **more) -> Archive:
    """An archive with stored indexes; a phrase of words that are all too short for one scans the chunks."""

    def lexical(terms: list[str], limit: int, allowed: Column) -> list[Row]:
        if any(len(t.split()) != 1 for t in terms):
            return search.lexical(chunks, terms, allowed, key, limit).select(key, "bm25").collect()
        return words.search(terms, limit, allowed)

    return Archive(chunks, lexical, lambda vector, limit: vectors.search(vector, limit, prove=prove), key, **more)


def lexical_list(a: Archive, query: str, limit: int, f: Filters) -> list[tuple]:
    """(key, memory) of the lexical candidates in order: the best by BM25, cut to the limit before time is looked at, then those
    that time admits. Where none is left, or a term is too short for trigrams, chunks that hold all terms anywhere follow, the
    first one of each memory that is not there yet."""
    best = [r[0] for r in a.lexical(expression(query), limit, f.stored())]
    of = {r[0]: r[1] for r in a.keyed(best).filter(f.shown()).select(a.key, a.memory).collect()} if best else {}
    out = [(k, of[k]) for k in best if k in of]
    terms = [t.lower() for t in _TOKEN.findall(query)]
    if terms and (not out or short_terms(query)):
        late = search.substring(a.chunks.filter(f.stored() & f.shown()), terms, a.key).filter(~F.col(a.memory).isin([m for _, m in out]))
        more = late.groupBy(a.memory).agg(F.min(a.key).alias("_first")).orderBy("_first").limit(max(1, limit - len(out)))
        out += [(r[1], r[0]) for r in more.collect()]
    return out


def semantic_list(a: Archive, vector: list[float], limit: int) -> list[tuple]:
    """(key, score) of the nearest vectors with a score that counts, in order of scores of six places."""
    rows = a.near(vector, limit)
    if not rows:
        return []
    told = a.chunks.sparkSession.createDataFrame([tuple(r) for r in rows], f"{a.key} {a.chunks.schema[a.key].dataType.simpleString()}, score double")
    return [tuple(r) for r in cleaned(told, a.least).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), a.key).collect()]


def _ranked(a: Archive, keys: list) -> DataFrame:
    return a.chunks.sparkSession.createDataFrame(list(zip(keys, range(1, len(keys) + 1), strict=True)), f"{a.key} {a.chunks.schema[a.key].dataType.simpleString()}, rank long")


def fused(chunks: DataFrame, channels: dict[str, DataFrame], f: Filters, key: str = "chunk_id", semantic: DataFrame | None = None) -> DataFrame:
    """Chunks of all channels that pass, with retrieval_score and channels. Ranks count rows that the filters then drop.

    semantic has (key, score) of rows that an earlier fusion found by meaning alone; a first fusion knows none.
    """
    ranked = search.fuse(channels, key)
    ranked = ranked.withColumn("_semantic", F.lit(None).cast("double")) if semantic is None else ranked.join(semantic.select(key, F.col("score").alias("_semantic")), key, "left")
    rows = chunks.join(F.broadcast(ranked), key).filter(f.passes())  # at most one top-k list a channel
    score = F.col("rrf") + search.metadata_boost(list(f.terms), bool(f.project), semantic=F.col("_semantic"))
    return rows.withColumn("retrieval_score", F.round(score, PLACES)).drop("rrf", "_semantic")


@dataclass(frozen=True)
class Found:
    """rows: what a search shows, with retrieval_score, channel and place. hidden: (memory, project, memory_type, conflict_key) of
    what a higher authority keeps out."""

    rows: DataFrame
    hidden: DataFrame


_GROUP = ["project", "memory_type", "conflict_key"]


def settled(a: Archive, rows: DataFrame, limit: int, mode: str) -> Found:
    """At most three chunks of a memory; in current views lower authorities of a conflict hidden; memories before evidence; the
    best `limit` with their place. rows is made once: it has no more than the top-k lists it came of."""
    updated = [F.col("updated").desc_nulls_last()] if "updated" in rows.columns else []
    order = [F.desc("retrieval_score"), F.desc("importance"), *updated, F.asc(a.key)]
    capped = search.cap_per_memory(rows, 3, a.memory, order).withColumn("channel", F.when(a.is_evidence(), "evidence").otherwise("memory"))
    kept = rows.sparkSession.createDataFrame(capped.collect(), capped.schema)
    named = F.trim(F.coalesce("conflict_key", F.lit(""))) != ""
    over = F.max(F.when(named, F.col("authority"))).over(Window.partitionBy(*_GROUP))
    lower = named & (F.col("authority") < over) if mode in ("current", "why") else F.lit(False)
    told = kept.withColumn("_lower", lower)
    full = [F.when(F.col("channel") == "memory", 0).otherwise(1), *order]
    shown = told.filter(~F.col("_lower")).drop("_lower").orderBy(*full).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*full)))
    return Found(shown, told.filter("_lower").select(a.memory, *_GROUP).distinct())


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\w{2,}", query.lower())))


def _fuse_lists(a: Archive, lexical: list, semantic: list[tuple], limit: int, f: Filters, alone: DataFrame | None = None) -> Found:
    near = {k: s for k, s in semantic}
    lists = {"lexical": _ranked(a, lexical), "semantic": _ranked(a, list(near))} if near else {"lexical": _ranked(a, lexical)}
    chunks = replace(a, chunks=a.keyed({*lexical, *near})).chunks
    rows = fused(chunks, lists, f, a.key, alone)
    scores = a.chunks.sparkSession.createDataFrame(list(near.items()), f"{a.key} {a.chunks.schema[a.key].dataType.simpleString()}, semantic_score double")
    return settled(a, rows.join(F.broadcast(scores), a.key, "left"), limit, f.mode)


def find(a: Archive, query: str, vector: list[float], limit: int, f: Filters) -> Found:
    """The search: both lists of candidates, fused, filtered and settled; semantic_score is that of rows found by meaning. Each list
    is made once and has at most OVERFETCH times `limit` rows (or LEAST_CANDIDATES); chunks are read by their keys."""
    n = max(OVERFETCH * limit, LEAST_CANDIDATES)
    f = replace(f, terms=tuple(query_words(query)))
    return _fuse_lists(a, [k for k, _ in lexical_list(a, query, n, f)], semantic_list(a, vector, n), limit, f)


def substring_list(a: Archive, query: str, limit: int, f: Filters) -> list:
    """Keys of chunks that hold all pieces of a query: those with the first piece in their title first (there '_' is any sign),
    then by weight and last change, cut to the limit before scope, project, tags and time are looked at."""
    cut = pieces(query)
    if not cut:
        return []
    held = F.lit(True)
    for p in cut:
        held = held & search.like_any(list(search.WEIGHTS), p)
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    title = low(F.coalesce("title", F.lit(""))).like(f"%{cut[0]}%".translate({i: i + 32 for i in range(65, 91)}))
    updated = [F.col("updated").desc_nulls_last()] if "updated" in a.chunks.columns else []
    first = a.chunks.filter(f.stored() & held).orderBy(F.when(title, 0).otherwise(1), F.col("weight").desc_nulls_last(), *updated, a.key).limit(limit)
    passing = first.withColumn("_passes", f.passes()).select(a.key, "_passes").collect()
    return [r[0] for r in passing if r[1]]


def find_enhanced(a: Archive, query: str, vector: list[float], limit: int, f: Filters) -> Found:
    """The search, and where it gives fewer rows than wanted a substring search behind it, fused once more: ranks are then
    places in the joined list, so scores change, and rows that were found by meaning alone get a little for it."""
    primary = find(a, query, vector, limit, f)
    known = primary.rows.orderBy("place").select(a.key, "channels", "semantic_score").collect()
    if len(known) >= limit:
        return primary
    late = [k for k in substring_list(a, query, max(3 * limit, 20), f) if k not in {r[0] for r in known}]
    kind = a.chunks.schema[a.key].dataType.simpleString()
    alone = a.chunks.sparkSession.createDataFrame([(r[0], r[2]) for r in known if list(r[1]) == ["semantic"]], f"{a.key} {kind}, score double")
    return _fuse_lists(a, [r[0] for r in known] + late, [], limit, replace(f, terms=tuple(query_words(query))), alone)


def explained(a: Archive, found: Found, query: str, vector: list[float], f: Filters, most: int = 50) -> DataFrame:
    """(key, excluded): for each row found, what of its conflict group a search in history finds but the view leaves out, with the
    reason: a lower authority that a row found keeps out, or time. Candidates are the first chunks of memories by searches for
    the query and each of its words, best first, then by meaning; at most `most` are kept, in that order."""
    group = [*_GROUP, "privacy"]
    shown = found.rows.select(a.key, a.memory, *group).collect()
    n = max(12 * len(shown), 60)
    past = replace(f, mode="history", statuses=(), terms=tuple(query_words(query)))
    first: dict = {}
    for q in [query, *sorted(set(past.terms))]:
        for k, m in lexical_list(a, q, n, past):
            first.setdefault(m, k)
    near = [k for k, _ in semantic_list(a, vector, n)]
    of = {r[0]: r[1] for r in a.keyed(near).select(a.key, a.memory).collect()} if near else {}
    for k in near:
        if k in of:
            first.setdefault(of[k], k)
    here = {tuple(r[g] for g in _GROUP) for r in shown}
    beaten = {r[0] for r in found.hidden.collect() if tuple(r[g] for g in _GROUP) in here}
    keys = [k for m, k in first.items() if m not in {r[1] for r in shown}]
    told = {r[0]: r for r in a.keyed(keys).filter(past.passes()).select(a.key, a.memory, *group, replace(f, mode="current").reason().alias("reason")).collect()} if keys else {}
    out = []
    for k in keys:
        if k in told and (told[k][1] in beaten or told[k].reason not in SHOWN):
            out.append((k, *(told[k][g] for g in group), "lower_authority_conflict" if told[k][1] in beaten else told[k].reason))
    kinds = a.chunks.schema
    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in (a.key, *group))
    out = a.chunks.sparkSession.createDataFrame(out[:most], f"{schema}, reason string").withColumnRenamed(a.key, "id")
    listed = out.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("id", "reason"))).alias("excluded"))
    same = [found.rows[g].eqNullSafe(listed[g]) for g in group]
    return found.rows.join(F.broadcast(listed), same, "left").select(found.rows[a.key], F.coalesce(F.to_json("excluded"), F.lit("[]")).alias("excluded"))


def core_list(rows: DataFrame, f: Filters, limit: int, pinned: Column, updated: Column, key: str = "memory_id") -> DataFrame:
    """Core memories by weight, importance and last change. Current views list pinned active ones. The limit comes before time,
    scope and project are looked at, so a list may be shorter than what there is to show; a project's case counts."""
    fine = (F.col("tier") == "core") & search.in_or_none("privacy", list(f.privacy))
    if f.mode in ("current", "why"):
        fine = fine & pinned & (F.col("status") == "active")
    first = rows.filter(fine).orderBy(F.col("weight").desc_nulls_last(), F.desc("importance"), updated.desc_nulls_last(), F.asc(key)).limit(limit)
    shown = f.reason().isin(SHOWN) & search.scope_visible(F.col("scopes"), f.agent)
    return first.filter(shown & F.contains("project", F.lit(f.project)) if f.project else shown)


# packs


def budgeted(items: DataFrame, group: list[str], order: list[str], text: str, budget: int, least: int, cut, frame: int = 0) -> DataFrame:
    """(group, order, text) of the items that a budget of characters takes in order; the last ones are cut to what is left.

    items must be a bounded list, as a top-k is: each group is one array that is folded in order. An item costs `frame`
    characters besides its text. The fold ends where less than `least` are left; an item of which the cut leaves nothing is
    passed over, and later ones may still fit. cut(text, budget) gives the shortened text.
    """
    listed = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("_items"))
    kind = listed.schema["_items"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("done"), F.array().cast(kind).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        left = F.lit(budget) - a["used"] - frame
        short = cut(x["t"], left)
        stop = a["done"] | (left < least)
        item = F.struct(*[x[o].alias(o) for o in order], short.alias("t"))
        took = F.struct((a["used"] + frame + F.length(short)).alias("used"), F.lit(False).alias("done"), F.array_append(a["kept"], item).alias("kept"))
        return F.when(stop, F.struct(a["used"].alias("used"), F.lit(True).alias("done"), a["kept"].alias("kept"))).when(short == "", a).otherwise(took)

    folded = listed.select(*group, F.explode(F.aggregate("_items", start, step, lambda a: a["kept"])).alias("x"))
    return folded.select(*group, *[F.col(f"x.{o}").alias(o) for o in order], F.col("x.t").alias(text))
