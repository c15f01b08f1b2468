"""Token counts and token ids by the vocabulary files of public tokenizers, in Arrow batches.

A text is cut at safe boundaries, before a blank that follows a printed character. The byte-level pre-tokenizer never
joins what stands on both sides of such a place, so the ids of the text are those of its chunks in order. Each distinct
chunk is encoded once per worker; a worker keeps a bounded number of them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm._shared import kept, slices

#: A chunk: blanks, then printed characters; where a character that is a blank of another kind precedes a blank, they stay together.
_CHUNK = re.compile(r"[ \n]*[^ \n]+(?:(?<=\s)[ \n]+[^ \n]*)*|[ \n]+")
_SAFE = re.compile(r"(?<=\S)[ \n]")
#: A blank that follows white space; texts without one are cut before every blank and line break.
_ODD = r"[\t-\r\x1c-\x1f \x{85}\pZ][ \n]"
#: Signs that the byte-level pre-tokenizer always parts from a letter before them (an apostrophe may go with what follows it).
_SIGNS = "!\"#$%&()*+,-./:;=?@"
#: Characters of one text that are cut into chunks at once.
_PART = 1 << 20


def parts(text: str, size: int = _PART) -> Iterator[str]:
    """A long text in parts that end at safe boundaries."""
    begin = 0
    while len(text) - begin > size and (m := _SAFE.search(text, begin + size)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


class _Chunks(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk):
        number = len(self)
        self[chunk] = number
        self.new.append(chunk)
        return number


def _spelled(key: str) -> str:
    """The chunk that a key of the cache stands for.

    A key without blanks is a chunk that one blank precedes, or that begins with a line break; one that ends with a blank is
    the begin of a text; one that begins with a blank is the chunk itself.
    """
    if key[:1] == " ":
        return key[1:]
    if key[-1:] == " ":
        return key[:-1]
    return key if key[:1] == "\n" else f" {key}"


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with `more` written behind its first `used` entries; room is doubled, so that appending is linear."""
    if used + len(more) > len(held):
        wider = np.empty(max(2 * len(held), used + len(more), 1 << 16), held.dtype)
        wider[:used] = held[:used]
        held = wider
    held[used : used + len(more)] = more
    return held


class ChunkEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library; special strings in texts as the library has them.

    Chunks of a slice are cut and numbered by Arrow, and each distinct one is looked up once. Beyond `limit` chunks those
    that only one slice has used leave first. A file whose rules are others is used on whole texts.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        rules = json.loads(self.tokenizer.to_str())
        before = rules.get("pre_tokenizer") or {}
        self.local = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not rules.get("normalizer")
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        added = {x["id"]: x["content"] for x in rules.get("added_tokens") or []}
        self.signs = "".join(c for c in _SIGNS if not any(c in x for x in added.values()))
        self.widths = self._widths(added) if self.local else np.empty(0, np.int64)
        self._hold(_Chunks(), np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int32))

    def _hold(self, numbers, flat, lengths, uses):
        self.numbers, self.flat, self.lengths, self.uses = numbers, flat, lengths, uses
        self.starts, self.known, self.n_flat = np.cumsum(lengths) - lengths, len(lengths), len(flat)

    def _evict(self):
        least, uses = 2, self.uses[: self.known]
        while np.count_nonzero(uses >= least) > self.limit // 2:
            least *= 2
        kept = np.flatnonzero(uses >= least)
        keys, numbers = list(self.numbers), _Chunks()
        for k in kept.tolist():
            dict.__setitem__(numbers, keys[k], len(numbers))
        lengths = self.lengths[kept]
        self._hold(numbers, self.flat[_spans(self.starts[kept], lengths)], lengths, uses[kept] // 2)

    def _widths(self, added: dict[int, str]) -> np.ndarray:
        """Bytes of each id: a byte-level token is spelled by one character a byte, an added one as it stands; 0 where no token has an id."""
        vocab = self.tokenizer.get_vocab()
        widths = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        for token, i in vocab.items():
            widths[i] = len(token.encode()) if i in added else len(token)
        return widths

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and how many each has; every chunk is a text of its own."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum())), sizes

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _each, for chunks that begin with a blank and end with a printed character: as one text, cut where chunks end by
        the bytes of its ids. Should ids not end where every chunk does, each is encoded alone."""
        flat = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.cumsum(np.asarray(pc.binary_length(pa.array(chunks, pa.string())), np.int64))
        upto = np.cumsum(self.widths[flat])
        last = np.searchsorted(upto, ends)
        if not len(upto) or upto[-1] != ends[-1] or (upto[last] != ends).any():
            return self._each(chunks)
        return flat, np.diff(last, prepend=-1)

    def _signed(self, new: list[str]) -> tuple[list[int], list[int], list[int]]:
        """Places of new keys that are a letter's chunk and signs behind it, and the numbers of both; what of these is new is learned too."""
        places, stems, tails = [], [], []
        for k, key in enumerate(new):
            stem = key.rstrip(self.signs)
            if len(stem) < len(key) and stem[-1:].isalpha() and stem[-1] < "\u0250":
                places.append(k)
                stems.append(self.numbers[stem])
                tails.append(self.numbers[f" {key[len(stem) :]}"])
        return places, stems, tails

    def _learn(self):
        new, self.numbers.new = self.numbers.new, []
        places, stems, tails = self._signed(new)
        new += self.numbers.new
        self.numbers.new = []
        first, n = self.known, len(new)
        whole = np.ones(n, bool)
        whole[places] = False
        starts, sizes = np.empty(n, np.int64), np.empty(n, np.int64)
        todo = np.flatnonzero(whole)
        for k in range(0, len(todo), 20_000):
            some = todo[k : k + 20_000]
            chunks = [_spelled(new[i]) for i in some.tolist()]
            joins = np.fromiter((x != "" and x[0] in " \n" and not x[-1].isspace() for x in chunks), bool, len(chunks))
            for mine, encode in ((joins, self._joined), (~joins, self._each)):
                if mine.any():
                    at = np.flatnonzero(mine)
                    flat, of_each = encode([chunks[i] for i in at.tolist()])
                    starts[some[at]], sizes[some[at]] = self.n_flat + np.cumsum(of_each) - of_each, of_each
                    self.flat, self.n_flat = _grown(self.flat, self.n_flat, flat), self.n_flat + len(flat)
        self.starts, self.lengths = _grown(self.starts, first, starts), _grown(self.lengths, first, sizes)
        self.uses = _grown(self.uses, first, np.zeros(n, np.int32))
        self.known = first + n
        if places:
            both = np.array([stems, tails]).T
            np.add.at(self.uses, both.ravel(), 1)
            lengths = self.lengths[both]
            flat, of_each = self.flat[_spans(self.starts[both].ravel(), lengths.ravel())], lengths.sum(axis=1)
            at = first + np.array(places)
            self.starts[at], self.lengths[at] = self.n_flat + np.cumsum(of_each) - of_each, of_each
            self.flat, self.n_flat = _grown(self.flat, self.n_flat, flat), self.n_flat + len(flat)

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk numbers of all texts one after another, how many each text has, and the distinct ones of most."""
        get = self.numbers.__getitem__
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        mine = np.fromiter(map(get, coded.dictionary.to_numpy(zero_copy_only=False)), np.int32, len(coded.dictionary))
        found = mine[coded.indices.to_numpy()]
        sizes = np.asarray(pc.list_value_length(split), np.int64)
        begins = np.cumsum(sizes) - sizes
        found[begins] = np.fromiter((get(f"{x} ") for x in split.flatten().take(pa.array(begins)).to_pylist()), np.int32, len(begins))
        if not odd.any():
            return found, sizes, mine
        cut = [np.fromiter((get(f" {c}") for c in _CHUNK.findall(x)), np.int32) for x in texts.filter(pa.array(odd)).to_pylist()]
        all_sizes = np.empty(len(texts), np.int64)
        all_sizes[~odd], all_sizes[odd] = sizes, list(map(len, cut))
        whole = np.empty(int(all_sizes.sum()), np.int32)
        from_odd = np.repeat(odd, all_sizes)
        whole[~from_odd], whole[from_odd] = found, np.concatenate(cut)
        return whole, all_sizes, mine

    def _read(self, texts: pa.Array, ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        if len(self.numbers) > self.limit:
            self._evict()
        found, sizes, used = self._numbered(texts)
        self._learn()
        self.uses[used] += 1
        lengths = self.lengths[found]
        upto = np.append(0, np.cumsum(lengths))
        ends = np.cumsum(sizes)
        return (self.flat[_spans(self.starts[found], lengths)] if ids else None), upto[ends] - upto[ends - sizes]

    def _parts(self, texts) -> Iterator[tuple[pa.Array, bool]]:
        """Texts as Arrow strings; a long one comes in parts, each of which goes on with the text before."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        long = np.flatnonzero(np.asarray(pc.binary_length(texts)) > 4 * _PART)
        at = 0
        for i in long.tolist():
            if i > at:
                yield texts.slice(at, i - at), False
            for k, part in enumerate(parts(texts[i].as_py())):
                yield pa.array([part], pa.string()), k > 0
            at = i + 1
        if at < len(texts):
            yield texts.slice(at), False

    def counts(self, texts) -> np.ndarray:
        if not self.local:
            return np.fromiter(map(len, self.encode(texts)), np.int64)
        out: list[np.ndarray] = []
        for part, more in self._parts(texts):
            sizes = self._read(part, False)[1]
            if more:
                out[-1] = out[-1] + sizes
            else:
                out.append(sizes)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def encode(self, texts) -> list[np.ndarray]:
        if not self.local:
            whole = [x or "" for x in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
            return [np.asarray(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        out: list[list[np.ndarray]] = []
        for part, more in self._parts(texts):
            flat, sizes = self._read(part, True)
            split = np.split(flat, np.cumsum(sizes)[:-1])
            if more:
                out[-1] += split
            else:
                out += [[x] for x in split]
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceEncoder:
    """Counts and ids by a sentencepiece model. It normalises blanks over the whole text, so texts are not cut."""

    dtype = np.uint32

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts) -> list[np.ndarray]:
        whole = [x or "" for x in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        return [np.asarray(x, np.uint32) for x in self.model.encode(whole, num_threads=1)]

    def counts(self, texts) -> np.ndarray:
        return np.fromiter(map(len, self.encode(texts)), np.int64, len(texts))


def encoder(path: str):
    """This worker's encoder for a file."""
    return kept(("encoder", path), lambda: PieceEncoder(path) if path.endswith(".model") else ChunkEncoder(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Operator 4: (id, n_bytes, n_tokens, over_limit) of every row.

    Only lengths leave the Arrow function. No shuffle; slices of a batch are balanced by bytes and long texts are cut
    at safe boundaries. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay as they are;
    other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def counted(batches):
        enc = encoder(tokenizer)
        for s in slices(batches, text_col):
            n = enc.counts(s.column(text_col))
            size = pc.cast(pc.fill_null(pc.binary_length(s.column(text_col)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([s.column(id_col), size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(counted, schema)
