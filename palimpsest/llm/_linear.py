"""Linear models on sparse rows, and character n-grams of words as numbers."""

from __future__ import annotations

import numpy as np

from palimpsest.llm._words import mixed


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, cost: np.ndarray | float = 1.0, epochs: int = 20, seed: int = 0) -> np.ndarray:
    """Weights of a linear hinge-loss classifier, the bias last. rows: (indices, values); y: -1 or 1; cost: of each row.

    Each step solves one dual variable exactly; epochs end early when no step moves a variable.
    """
    rng, w, alpha = np.random.default_rng(seed), np.zeros(dims + 1), np.zeros(len(rows))
    cost = np.broadcast_to(np.asarray(cost, float), len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[dims]) - 1.0
            now = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (now - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[dims] += step
                moved = max(moved, abs(step))
                alpha[i] = now
        if moved < 1e-4:
            break
    return w


def gram_ids(words: list[bytes], sizes: tuple[int, ...], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of blank-padded words: flat ids, and how many each word has."""
    padded = [b" " + w + b" " for w in words]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    flat = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(padded)), lengths)
    ids, owner = [], []
    for n in sizes:
        if len(flat) < n:
            continue
        acc = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            acc = acc * np.uint64(257) + flat[k : k + len(acc)]
        inside = word[: len(acc)] == word[n - 1 : n - 1 + len(acc)]
        ids.append((mixed(acc[inside]) % np.uint64(dims)).astype(np.int64))
        owner.append(word[: len(acc)][inside])
    owner_, ids_ = np.concatenate(owner) if owner else np.empty(0, np.int64), np.concatenate(ids) if ids else np.empty(0, np.int64)
    order = np.argsort(owner_, kind="stable")
    return ids_[order], np.bincount(owner_, minlength=len(words))


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; empty runs are zero."""
    out = np.zeros((len(lengths), *values.shape[1:]))
    held = lengths > 0
    if held.any():
        out[held] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[held], axis=0)
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
