"""Many patterns against many texts: which text holds which pattern, each text read once a block of patterns."""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of patterns that one automaton is made of; it takes about a hundred bytes for each.
BLOCK_CHARS = 1 << 20
_MADE: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, patterns: list[str]) -> ahocorasick.Automaton:
    """The automaton of a block, made once a worker; that of another block is dropped."""
    if name not in _MADE:
        _MADE.clear()
        made = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            made.add_word(p, i)
        made.make_automaton()
        _MADE[name] = made
    return _MADE[name]


def containing(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, item: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, id) for each text that holds an item's pattern as it is written. Null texts and patterns hold and match nothing,
    the empty pattern is in every text, equal patterns of several items match for each.

    Distinct patterns fall in blocks of about `block_chars` by a hash; a block is sent to all tasks as an automaton, which finds
    all its patterns in one pass over a text. A task gives each distinct pattern of a text once; items join by pattern number.
    """
    known = patterns.select(item, pattern).filter(F.col(pattern).isNotNull())
    distinct = known.filter(F.col(pattern) != "").select(F.col(pattern).alias("_p")).distinct()
    total = distinct.agg(F.sum(F.length("_p"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    read = texts.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    kind = read.schema[id_col].dataType.simpleString()
    out = read.crossJoin(F.broadcast(known.filter(F.col(pattern) == "").limit(1).select(F.lit("").alias("_p")))).select(id_col, "_p")  # at most one row
    for k in range(blocks if total else 0):
        block = [r[0] for r in distinct.filter(F.pmod(F.xxhash64("_p"), F.lit(blocks)) == k).collect()]  # bounded by block_chars
        if not block:
            continue
        name = uuid.uuid4().hex

        def found(batches, block=block, name=name):
            automaton = _automaton(name, block)
            for b in batches:
                rows, hits = [], []
                for i, text in enumerate(b.column(text_col).to_pylist()):
                    of = {v for _, v in automaton.iter(text)}
                    rows += [i] * len(of)
                    hits += [block[v] for v in of]
                yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], [id_col, "_p"])

        out = out.unionByName(read.mapInArrow(found, f"`{id_col}` {kind}, _p string"))
    return out.join(known.withColumnRenamed(pattern, "_p"), "_p").select(item, id_col)


def folded(c: Column) -> Column:
    """ASCII letters in lower case, others as they are: how LIKE compares here."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like(c: Column, pattern: Column) -> Column:
    """LIKE without regard to the case of ASCII letters, without an escape character: '%' and '_' always are wildcards."""
    quoted = F.regexp_replace(folded(pattern), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(folded(c), F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")), F.lit("$(?!\n)")))


def quoted_in(texts: DataFrame, refs: DataFrame, id_col: str, text_col: str, ref: str) -> DataFrame:
    """(ref, id) of texts that are LIKE '%"ref"%', with LIKE's wildcards in ref and without regard to the case of ASCII letters.

    A reference without quotes and wildcards is there exactly if it lies between two neighbouring quotes, so what lies between
    quotes is joined by its hash. Others are found by their longest piece without wildcards, and then compared as a whole.
    """
    plain = ~F.col(ref).rlike('["%_]')
    read = texts.select(id_col, folded(F.col(text_col)).alias("_t"))
    between = F.split("_t", '"')
    segments = read.select(id_col, F.explode(F.array_distinct(F.slice(between, 2, F.greatest(F.size(between) - 2, F.lit(0))))).alias("_s"))
    easy = refs.filter(plain).select(ref, folded(F.col(ref)).alias("_s"))
    direct = segments.join(easy, "_s").select(ref, id_col)
    pieces = F.split(F.concat(F.lit('"'), folded(F.col(ref)), F.lit('"')), "[%_]")
    longest = F.reduce(pieces, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    hard = refs.filter(~plain).select(ref, longest.alias("_piece"))
    near = containing(read, hard, id_col, "_t", ref, "_piece").distinct()
    whole = near.join(read, id_col).filter(like(F.col("_t"), F.concat(F.lit('%"'), F.col(ref), F.lit('"%'))))
    return direct.unionByName(whole.select(ref, id_col)).distinct()


