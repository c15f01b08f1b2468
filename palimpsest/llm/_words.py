"""Words of texts as integers: each distinct word is described once per worker, the rest is numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from palimpsest.llm._shared import kept

#: Longer texts are split into words piece by piece.
PIECE_BYTES = 4 << 20
_BLANK = b" \t\n\r\x0b\x0c"


class _Numbered(dict):
    """Numbers keys in the order of their first lookup and remembers the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key):
        number = len(self)
        self[key] = number
        self.new.append(key)
        return number


def pieces(text: bytes, size: int = PIECE_BYTES):
    """Parts of a text, cut where a blank follows a word, so that no word is split."""
    begin = 0
    while len(text) - begin > size:
        cut = begin + size
        while cut < len(text) and text[cut] not in _BLANK:
            cut += 1
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


class WordIndex:
    """Maps words (runs without the six ASCII blanks) to numbers and describes each distinct word by a row of arrays.

    describe(list of words) returns a tuple of arrays, one entry per word. The index is emptied before a slice when
    it holds more than `limit` words, so its memory is bounded; numbers hold within one slice only.
    """

    def __init__(self, describe: Callable[[list[bytes]], tuple[np.ndarray, ...]], limit: int = 600_000):
        self.describe, self.limit = describe, limit
        self._clear()

    def _clear(self):
        self.numbers, self.columns = _Numbered(), None

    def __call__(self, texts: list[bytes]) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
        """Word numbers of each text, and the descriptions that they index."""
        if len(self.numbers) > self.limit:
            self._clear()
        get, out = self.numbers.__getitem__, []
        for text in texts:
            found = [np.fromiter(map(get, w), np.int32, len(w)) for w in (p.split() for p in pieces(text))]
            out.append(found[0] if len(found) == 1 else np.concatenate(found))
        if self.numbers.new or self.columns is None:
            told = self.describe(self.numbers.new)
            self.columns = told if self.columns is None else tuple(np.concatenate(x) for x in zip(self.columns, told, strict=True))
            self.numbers.new = []
        return out, self.columns


def hashes(words: list[bytes]) -> tuple[np.ndarray]:
    """64-bit hashes of words."""
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2**64 / golden ratio
_S31, _S29 = np.uint64(31), np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _S31)) * _MULTIPLIER
    x = (x ^ (x >> _S29)) * _MULTIPLIER
    return x ^ (x >> _S31)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes; empty when there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + count]) * _MULTIPLIER
        out ^= out >> _S29
    return mixed(out)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _MULTIPLIER + b)


def runs(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of each n consecutive word hashes for several n, by doubling: a run is the join of its binary parts."""
    powers, out = {1: mixed(words)}, []
    for n in sizes:
        count, at, done = len(words) - n + 1, 0, None
        for bit in range(n.bit_length() - 1, -1, -1):
            if not n >> bit & 1:
                continue
            for k in range(bit):
                if 2 << k not in powers:
                    half = powers[1 << k]
                    powers[2 << k] = _joined(half[: max(0, len(half) - (1 << k))], half[1 << k :])
            part = powers[1 << bit][at : at + max(0, count)]
            done = part if done is None else _joined(done, part)
            at += 1 << bit
        out.append(done)
    return out


def extremes(x: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of each n consecutive values."""
    size = 1
    while size * 2 <= n:
        x = pick(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    rest = n - size
    return pick(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and the number of words of each."""
    index = kept("hashes", lambda: WordIndex(hashes))
    numbers, (h,) = index(texts)
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    return (h[np.concatenate(numbers)] if len(numbers) else np.empty(0, np.uint64)), lengths
