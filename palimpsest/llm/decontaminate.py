"""Operator 3: benchmark decontamination by templates.

Texts and benchmark items become templates: numbers, names (capitalised words) and units after numbers turn into typed
placeholders, other words lose case and edge punctuation, and neighbouring names are one slot. Windows of eight template
tokens are hash-joined: an item's windows form a sorted table in every task, looked up for all windows of a slice at once.
Windows that are poor in literals are looked up by their exact values; an item that has no other windows is looked up as a whole
too, by its template, if that has five tokens and a literal. A window that many different items share is kept for all of them. It
makes an item a candidate only in a run of LONG tokens, which are looked up by windows of that length, or if the item has no other windows; beside a window
of the item's own it counts like any other. With shared=True it is evidence like any other everywhere: all items that it leads to are
bounded together by the runs that they have in the text, and judged if these can cover enough. A match is extended as far as the templates
agree, and such runs are judged alone, chained to occurrences in document order, and pooled. A document is contaminated by an
item if one of these covers enough of the item, or is one long run, and if its slots agree: the same item value must stand for
the same document value, so a question with other numbers or names is caught and a chance mix of templates is not.

The benchmark is a query set: it is read in blocks of a bounded size, each of which is broadcast and meets all documents in
one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import as_bytes, kept, materialise, slices
from palimpsest.llm._words import WordIndex, runs

WINDOW = 8
LEAST_LITERALS = 3
#: An item without rich windows is looked up by its whole template if it has so many tokens: "NAME NUMBER prime" says too little.
WHOLE_TOKENS = 5
#: A window that more different items than this have, as a line of instructions, is no evidence of one of them by itself,
#: unless it is asked to be (shared=True); then such windows are only looked up in another way.
SHARED = 20
#: Template tokens of one run that contaminate whatever their share of the item.
LONG = 32
#: Pairs of a window of a text and one of an item that are held at once.
PAIRS = 1 << 20
#: UTF-8 bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 4 << 20
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg t ton tons lb lbs oz ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent € $ £ dollars euros cents pounds km/h mph °c °f degrees w kw v a hz kb mb gb tb".split())
_LITERAL, _NUMBER, _NAME, _UNIT, _NOTHING = range(5)
_EDGES = re.compile(r"^[^\w€$£%°]+|[^\w€$£%°]+$")
_DIGITS = re.compile(r"[-+€$£]?\d[\d.,:/]*(?:e[-+]?\d+)?(?:st|nd|rd|th)?[%€$£]?", re.I)


def _described(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Kind and value of each word."""
    kinds, values = np.empty(len(words), np.int8), np.empty(len(words), np.uint64)
    for i, raw in enumerate(words):
        word = _EDGES.sub("", raw.decode("utf-8", "replace"))
        low = word.lower()
        kinds[i] = _NOTHING if not word else _NUMBER if _DIGITS.fullmatch(word) else _UNIT if low in UNITS else _NAME if word[0].isupper() and (len(word) == 1 or not word.isupper()) else _LITERAL
        values[i] = xxhash.xxh3_64_intdigest(low.encode())
    return kinds, values


def templates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, kind, value, text) of every template token of all texts, in order."""
    numbers, (kinds, values) = kept("templates", lambda: WordIndex(_described))(texts)
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
    kind, value, text = kinds[flat], values[flat], np.repeat(np.arange(len(numbers)), lengths)
    held = kind != _NOTHING
    kind, value, text = kind[held], value[held], text[held]
    same = np.append(False, text[1:] == text[:-1])[: len(text)]
    before = np.append(_NOTHING, kind[:-1])[: len(kind)]
    kind = np.where((kind == _UNIT) & ~(same & (before == _NUMBER)), _LITERAL, kind).astype(np.int8)
    first = ~((kind == _NAME) & same & (before == _NAME))
    starts = np.flatnonzero(first)
    if len(starts) < len(kind):
        value = np.add.reduceat(value * np.where(first, 1, 3).astype(np.uint64), starts)
        kind, text = kind[starts], text[starts]
    token = np.where(kind == _LITERAL, value, kind.astype(np.uint64))
    return token, kind, value, text


def _windows(token: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that lie within one text."""
    (h,) = runs(token, n)
    starts = np.flatnonzero(text[: len(h)] == text[n - 1 : n - 1 + len(h)])
    return starts, h[starts]


def _exact(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    return value * np.uint64(31) + kind.astype(np.uint64)


def _searched(token: np.ndarray, kind: np.ndarray, value: np.ndarray, text: np.ndarray, count: int, window: int = WINDOW):
    """(n, exact, hash, start, item) of the windows that each item is searched by, for each size; ordered by hash, item and start."""
    sizes = np.bincount(text, minlength=count)
    first = np.cumsum(sizes) - sizes
    literal = np.append(0, np.cumsum(kind == _LITERAL))
    least = np.minimum(sizes, window)
    windows = {n: _windows(token, text, n) for n in sorted({int(n) for n in least if n})}
    poor = np.ones(count, bool)  # no window of the item has enough literals
    for n, (starts, _) in windows.items():
        poor[text[starts[(least[text[starts]] == n) & (literal[starts + n] - literal[starts] >= LEAST_LITERALS)]]] = False
    whole = [i for i in np.flatnonzero(poor & (sizes >= WHOLE_TOKENS)) if literal[first[i] + sizes[i]] > literal[first[i]]]
    for n in sorted({*windows, *(int(sizes[i]) for i in whole)}):
        for exact in (False, True):
            starts, h = windows[n] if n in windows and not exact else _windows(_exact(kind, value) if exact else token, text, n)
            item = text[starts]
            rich = literal[starts + n] - literal[starts] >= LEAST_LITERALS
            chosen = (least[item] == n) & (rich != exact)
            if not exact:
                chosen |= np.isin(item, whole) & (sizes[item] == n)
            starts, h, item = starts[chosen], h[chosen], item[chosen]
            order = np.lexsort((starts, item, h))
            if len(order):
                yield n, exact, h[order], starts[order], item[order]


def _contents(kind: np.ndarray, value: np.ndarray, text: np.ndarray, count: int) -> list[bytes]:
    """Kinds and values of each item; items that are equal in them are found alike."""
    sizes = np.bincount(text, minlength=count)
    ends = np.cumsum(sizes)
    return [kind[a:b].tobytes() + value[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]


class Block:
    """Template windows of some benchmark items, sorted by hash, for each window size that occurs.

    Items of equal content are one, with several ids. A window is common if more than SHARED different items have it. `own` holds the
    other windows, `common` the common ones of all items; `crowds` are windows that make an item a candidate although no window
    of its own is met: those of items that have none, and all of LONG tokens whose windows are common.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        token, kind, value, text = templates([(t or "").encode() for _, t in items])
        numbers: dict[bytes, int] = {}
        which = np.array([numbers.setdefault(c, len(numbers)) for c in _contents(kind, value, text, len(items))], np.int64)
        self.ids = [(int(n), i) for n, (i, _) in zip(which, items, strict=True)]
        firsts = np.zeros(len(items), bool)
        firsts[np.unique(which, return_index=True)[1]] = True
        held = firsts[text]
        self.token, self.kind, self.value, self.text = token[held], kind[held], value[held], which[text[held]]
        self.sizes = np.bincount(self.text, minlength=len(numbers))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.drafts = list(_searched(self.token, self.kind, self.value, self.text, len(numbers), window))
        self.window = window
        self.divide(lambda n, exact, h, holders: h[holders > SHARED])

    def divide(self, common) -> None:
        """Tells common windows from others; common(n, exact, hashes, items of each) gives the hashes of the common ones."""
        self.own, self.common, self.lone = [], [], np.ones(len(self.sizes), bool)
        own, shared = np.zeros(len(self.token) + 1, np.int64), np.zeros(len(self.token) + 1, np.int64)
        for n, exact, h, starts, item in self.drafts:
            pairs = np.append(True, (h[1:] != h[:-1]) | (item[1:] != item[:-1]))
            hashes, at = np.unique(h, return_inverse=True)
            told = np.isin(h, common(n, exact, hashes, np.bincount(at, pairs)))
            self.lone[item[~told]] = False
            for tables, chosen in ((self.own, ~told), (self.common, told)):
                if chosen.any():
                    tables.append((n, exact, h[chosen], starts[chosen], item[chosen]))
            if n == self.window:
                shared[starts[told] + 1] = 1
                own[starts[~told & (not exact)] + 1] = 1
        self.crowds = [(n, exact, h[c], item[c]) for n, exact, h, _, item in self.common if (c := self.lone[item]).any()]
        if self.common:
            starts, h = _windows(self.token, self.text, LONG)
            last = starts + LONG - self.window + 1
            own, shared = np.cumsum(own), np.cumsum(shared)
            chosen = (own[last] == own[starts]) & (shared[last] > shared[starts]) & ~self.lone[self.text[starts]]
            starts, h = starts[chosen], h[chosen]
            order = np.lexsort((starts, self.text[starts], h))
            if len(order):
                self.crowds.append((LONG, False, h[order], self.text[starts[order]]))

    def reached(self, token: np.ndarray, spots: list[tuple], coverage: float) -> np.ndarray:
        """Items that common windows of one text, at `spots`, lead to, if all their runs in the text together cover enough of them.

        No occurrence of an item covers more than these runs do, so none that could be told is left out.
        """
        ends, keys, width = self.first + self.sizes, [], len(self.token) + 1

        def extended(part):
            """Where the runs of an item begin and end in it, as one number."""
            sizes = [len(s[3]) for s in part]
            a, n = np.repeat([s[0] for s in part], sizes), np.repeat([s[1] for s in part], sizes)
            b, item = np.concatenate([s[3] for s in part]), np.concatenate([s[4] for s in part])
            order = np.lexsort((a, a - b, item))
            a, b, n, item = a[order], b[order], n[order], item[order]
            begins = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | ((a - b)[1:] != (a - b)[:-1]) | (a[1:] > (a + n)[:-1])))
            low, shift, item = b[begins], (a - b)[begins], item[begins]
            high = np.maximum.reduceat(b + n, begins)
            live = np.arange(len(low))
            while len(live := live[(low[live] > self.first[item[live]]) & (low[live] + shift[live] > 0)]) and len(live := live[self.token[low[live] - 1] == token[low[live] + shift[live] - 1]]):
                low[live] -= 1
            live = np.arange(len(low))
            while len(live := live[(high[live] < ends[item[live]]) & (high[live] + shift[live] < len(token))]) and len(live := live[self.token[high[live]] == token[high[live] + shift[live]]]):
                high[live] += 1
            return np.unique(low * width + high)

        part, held = [], 0
        for spot in spots:
            part.append(spot)
            held += len(spot[3])
            if held >= PAIRS:
                keys.append(extended(part))
                part, held = [], 0
        keys = np.unique(np.concatenate([*keys, *([extended(part)] if part else [])]))
        low, high = keys // width, keys % width
        covered = np.maximum(0, high - np.maximum(low, np.append(0, np.maximum.accumulate(high)[:-1])))
        items, at = np.unique(self.text[low], return_inverse=True)
        return items[np.bincount(at, covered) >= coverage * self.sizes[items] - 1e-6]

    def matches(self, texts: list[bytes], coverage: float, agreement: float, once: bool = True, shared: bool = False):
        """(text, item, windows, coverage, slots, agreement) of each text and item that it holds, of the best occurrence.

        Items without a window of their own in the text are told once for a passage, by the first that holds, or each. With `shared`
        common windows are evidence like others, and all items that they lead to are judged by coverage and agreement.
        """
        token, kind, value, text = templates(texts)
        found, templated, own = defaultdict(list), defaultdict(list), defaultdict(Counter)

        def hits(n, exact, hashes):
            """Places of windows that are in a table, and where they are in it."""
            at, h = _windows(_exact(kind, value) if exact else token, text, n)
            low = np.searchsorted(hashes, h)
            for k in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h):
                yield int(at[k]), int(low[k]), int(np.searchsorted(hashes, h[k], side="right"))

        def add(t, item, a, b, n, exact):
            found[t, item].append((a, b, n))
            if not exact:
                templated[t, item].append((a, b, n))

        for n, exact, hashes, starts, items in self.own:
            for a, low, high in hits(n, exact, hashes):
                for j in range(low, high):
                    add(int(text[a]), int(items[j]), a, int(starts[j]), n, exact)
                    own[int(text[a])][int(items[j])] += not exact
        spots, seeds = defaultdict(list), defaultdict(list)
        for n, exact, hashes, starts, items in self.common:
            for a, low, high in hits(n, exact, hashes):
                spots[int(text[a])].append((a, n, exact, starts[low:high], items[low:high]))
        for n, exact, hashes, items in self.crowds if spots else []:
            for a, low, high in hits(n, exact, hashes):
                seeds[int(text[a])].append((a, n, items[low:high]))

        def gather(t, item):
            """Adds the common windows of an item."""
            for a, n, exact, starts, items in spots[t]:
                for j in range(*np.searchsorted(items, [item, item + 1])):
                    add(t, item, a, int(starts[j]), n, exact)

        def judged(t, item, parts):
            covered, slots, seen = set(), defaultdict(Counter), set()
            for a, b, n in parts:
                covered.update(range(b, b + n))
                for k in range(n):
                    if kind[a + k] != _LITERAL and (a + k, b + k) not in seen:
                        seen.add((a + k, b + k))
                        slots[int(self.value[b + k])][int(value[a + k])] += 1
            total = sum(sum(c.values()) for c in slots.values())
            agreed = sum(max(c.values()) for c in slots.values()) / total if total else 1.0
            share = len(covered) / int(self.sizes[item])
            passed = agreed >= agreement and (share >= coverage and (shared or self.lone[item] or item in own[t]) or len(parts) == 1 and parts[0][2] >= LONG)
            return passed, share, agreed, total, parts

        def told(t, item):
            """Whether the text holds the item, coverage, agreement, slots and matched runs."""
            pairs = found[t, item]
            begin, end = int(self.first[item]), int(self.first[item] + self.sizes[item])
            first, last = np.searchsorted(text, [t, t + 1])
            runs_ = []
            for a, b, n in sorted(pairs, key=lambda p: (p[0] - p[1], p[0])):
                if runs_ and runs_[-1][0] - runs_[-1][1] == a - b and a + n <= runs_[-1][0] + runs_[-1][2]:
                    continue
                low, high = 0, n
                while b - low > begin and a - low > first and self.token[b - low - 1] == token[a - low - 1]:
                    low += 1
                while b + high < end and a + high < last and self.token[b + high] == token[a + high]:
                    high += 1
                runs_.append((a - low, b - low, low + high))
            chains, done = [], []
            for a, b, n in sorted(runs_):
                done += [c for c in chains if a - c[-1][0] - c[-1][2] > end - begin]
                chains = [c for c in chains if a - c[-1][0] - c[-1][2] <= end - begin]
                before = [c for c in chains if c[-1][0] < a and c[-1][1] < b and c[-1][1] + c[-1][2] < b + n]
                if before:
                    min(before, key=lambda c: abs(a - b - c[-1][0] + c[-1][1])).append((a, b, n))
                else:
                    chains.append([(a, b, n)])
            return max(judged(t, item, parts) for parts in ([[r] for r in runs_] + [c for c in done + chains if len(c) > 1] + [templated[t, item], templated[t, item][: own[t][item]]]))

        for t in sorted(own.keys() | seeds.keys() | (spots.keys() if shared else set())):
            passages, tried = [], set(own[t])
            for item in sorted(tried):
                gather(t, item)
                passed, share, agreed, total, parts = told(t, item)
                if passed:
                    passages += [(a, a + n) for a, _, n in parts]
                    yield t, item, len(found[t, item]), share, total, agreed
            for a, n, items in sorted(seeds[t], key=lambda s: s[:2]):
                for item in map(int, items):
                    if once and any(x <= a and a + n <= y for x, y in passages):
                        break
                    if item in tried:
                        continue
                    tried.add(item)
                    gather(t, item)
                    passed, share, agreed, total, parts = told(t, item)
                    if passed:
                        passages += [(x, x + k) for x, _, k in parts]
                        yield t, item, len(found[t, item]), share, total, agreed
            if not shared or not spots[t] or once and passages:
                continue
            first, last = np.searchsorted(text, [t, t + 1])
            for item in self.reached(token[first:last], [(a - first, n, exact, starts, items) for a, n, exact, starts, items in spots[t]], coverage).tolist():
                if item in tried:
                    continue
                gather(t, item)
                passed, share, agreed, total, parts = told(t, item)
                if passed:
                    yield t, item, len(found[t, item]), share, total, agreed
                    if once:
                        break


def common_windows(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, exact, h) of the windows that more than SHARED different items of the whole benchmark have."""

    def listed(batches):
        for s in slices(batches, text_col):
            token, kind, value, text = templates(as_bytes(s.column(text_col)))
            names = np.array([xxhash.xxh3_64_intdigest(c) for c in _contents(kind, value, text, s.num_rows)], np.uint64).view(np.int64)
            for n, exact, h, _, item in _searched(token, kind, value, text, s.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(np.full(len(h), exact)), pa.array(h.view(np.int64)), pa.array(names[item])], ["n", "exact", "h", "content"])

    rows = benchmark.select(text_col).mapInArrow(listed, "n int, exact boolean, h long, content long").distinct()
    return rows.groupBy("n", "exact", "h").count().filter(F.col("count") > SHARED).select("n", "exact", "h")


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, agreement: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", once: bool = True, shared: bool = False) -> DataFrame:
    """(id, item, n_windows, coverage, n_slots, agreement) of each row of docs and item that contaminates it.

    Whole texts are searched. Null or wordless texts and items match nothing; windows with fewer than three literal tokens
    are searched for by their exact values, items of such windows alone, if of five tokens and more, as a whole by their template also. A row that
    holds of some items only what more than SHARED items of the benchmark have is told once for each passage and block, by the first of
    these items whose rules it meets; with once=False it is told for each of them. Either way the same rows of docs are found. By default
    what so many items share contaminates only as a run of LONG tokens, beside a window of the item's own, or if the item has nothing
    else; with shared=True it is judged as what few items share, by coverage and agreement alone, whatever their number. Coverage
    and slots are those of the best occurrence; of equally good ones, all have the same figures. Repeated rows give a row each, null
    ids stay, other columns are not read, and empty tables give an empty result.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kind.simpleString()}, _item int, n_windows long, coverage double, n_slots long, agreement double"
    names = [id_col, "_item", "n_windows", "coverage", "n_slots", "agreement"]

    def search(held):
        made = Block(held)
        if whole:
            made.divide(lambda n, exact, h, holders: whole[0].filter((F.col("n") == n) & (F.col("exact") == exact)).join(spark.createDataFrame(pa.table({"h": h.view(np.int64)})), "h", "left_semi").toArrow()["h"].to_numpy().view(np.uint64))
        made.drafts = None
        block = spark.sparkContext.broadcast(made)

        def searched(batches):
            for s in slices(batches, text_col):
                rows = list(block.value.matches(as_bytes(s.column(text_col)), coverage, agreement, once, shared))
                t, item, windows, share, slots, agreed = (list(x) for x in zip(*rows, strict=True)) if rows else ([],) * 6
                yield pa.RecordBatch.from_arrays([s.column(id_col).take(pa.array(t, pa.int64())), pa.array(item, pa.int32()), pa.array(windows, pa.int64()), pa.array(share, pa.float64()), pa.array(slots, pa.int64()), pa.array(agreed, pa.float64())], names)

        ids = spark.createDataFrame(made.ids, f"_item int, {item_col} {item_kind}")
        return docs.select(id_col, text_col).mapInArrow(searched, schema).join(F.broadcast(ids), "_item").select(id_col, item_col, *names[2:])

    parts, held, size, whole = [], [], 0, []
    items = benchmark.select(item_col, item_text_col).filter(F.col(item_text_col).isNotNull())
    for row in items.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            whole = whole or [materialise(common_windows(items, item_text_col), "common")]
            parts.append(search(held))
            held, size = [], 0
    if held or not parts:
        parts.append(search(held))
    return reduce(DataFrame.unionByName, parts)
