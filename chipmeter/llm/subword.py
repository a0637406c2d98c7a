"""Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A word (run of characters that are not ASCII white space) has one feature for itself and one for each of its character
n-grams, word borders included. If the shape says so, each pair of neighbouring words has a feature too, and all pairs of equal words share one, as a word
that is repeated is seldom one of those learned from. Features are hashed to
rows of one embedding table. A document's vector is the mean over all features of all its words and pairs. The model is
linear after that, so a trained model gives each word and pair one number per class, and a text is scored by adding them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose sums a task remembers before it starts afresh; bounds memory, not results.
CACHE = 400_000


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 18
    dim: int = 16
    grams: tuple[int, ...] = (1, 2, 3, 4)
    lower: bool = True
    #: Pairs of neighbouring words have features.
    pairs: bool = False


def words_of(text: str | None, lower: bool) -> list[str]:
    text = text or ""
    return _WORD.findall(text.lower() if lower else text)


def features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of all features of all words, one word after the other, how many each word has, and the words' hashes."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    word_no = np.repeat(np.arange(len(words)), size)
    left = end[word_no] - np.arange(len(flat))  # characters from here to the word's end
    ids, owner = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(flat), np.uint64)
        for n in range(1, max(shape.grams) + 1):
            h[: len(flat) - n + 1] = (h[: len(flat) - n + 1] ^ flat[n - 1 :]) * _MIX + np.uint64(n)
            if n in shape.grams:
                at = np.flatnonzero(left >= n)
                g = h[at] ^ (h[at] >> np.uint64(29))
                ids.append((g * _MIX >> np.uint64(33)) % np.uint64(shape.buckets))
                owner.append(word_no[at])
        power = np.cumprod(np.full(int(size.max()), _MIX | np.uint64(1), np.uint64))
        whole = np.add.reduceat(flat * power[np.arange(len(flat)) - (end - size)[word_no]], end - size)
        whole = (whole ^ (whole >> np.uint64(31))) * _MIX
        ids.append((whole >> np.uint64(33)) % np.uint64(shape.buckets))
        owner.append(np.arange(len(words)))
    own = np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return np.concatenate(ids)[order].astype(np.int64), np.bincount(own, minlength=len(words)), whole


def pair_features(hashes: np.ndarray, shape: Shape) -> np.ndarray:
    """Row numbers of the pairs of neighbouring words; a word that repeats the one before it is one pair, whatever the word."""
    with np.errstate(over="ignore"):
        z = (hashes[:-1] * np.uint64(3) ^ (hashes[1:] >> np.uint64(7))) * _MIX
        out = ((z ^ (z >> np.uint64(32))) % np.uint64(shape.buckets)).astype(np.int64)
    out[hashes[:-1] == hashes[1:]] = 0
    return out


@dataclass
class Model:
    shape: Shape
    classes: list
    table: np.ndarray  # buckets x classes: each feature's share of the logits
    bias: np.ndarray

    def logits(self, texts: list[str | None], chunk: int = 128) -> np.ndarray:
        """One row of logits for each text; texts without words get the bias alone."""
        out = np.zeros((len(texts), len(self.classes)))
        known: dict[str, int] = self.__dict__.setdefault("_known", {})
        sums = self.__dict__.setdefault("_sums", [np.zeros((0, len(self.classes) + 1), np.float32), np.zeros(0, np.uint64)])
        for start in range(0, len(texts), chunk):
            split = [words_of(t, self.shape.lower) for t in texts[start : start + chunk]]
            distinct = set().union(*split)
            new = sorted(distinct.difference(known))
            if new:
                if len(known) + len(new) > CACHE:
                    known.clear()
                    sums[:] = sums[0][:0], sums[1][:0]
                    new = sorted(distinct)
                self._learn(new, known, sums)
            for k, ws in enumerate(split, start):
                if ws:
                    at = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                    total = sums[0][at].sum(axis=0, dtype=np.float64)
                    if self.shape.pairs:
                        total[:-1] += self.table[pair_features(sums[1][at], self.shape)].sum(axis=0, dtype=np.float64)
                        total[-1] += len(ws) - 1
                    out[k] = total[:-1] / total[-1]
        return out + self.bias

    def _learn(self, new: list[str], known: dict, sums: list) -> None:
        ids, count, hashes = features(new, self.shape)
        part = np.add.reduceat(self.table[ids], np.cumsum(count) - count, axis=0)
        have = len(known)
        if have + len(new) > len(sums[0]):
            more = np.zeros((max(2 * len(sums[0]), have + len(new), 4096), len(self.classes) + 1), np.float32)
            more[:have] = sums[0][:have]
            sums[:] = more, np.concatenate([sums[1][:have], np.zeros(len(more) - have, np.uint64)])
        sums[1][have : have + len(new)] = hashes
        sums[0][have : have + len(new)] = np.column_stack([part, count])
        known.update(zip(new, range(have, have + len(new))))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list, shape: Shape, epochs: int = 5, rate: float = 0.5, seed: int = 7, weights: dict | None = None) -> Model:
    """Plain stochastic gradient descent, one document a step, the rate falling to zero in a straight line."""
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (shape.buckets, shape.dim)).astype(np.float32) / shape.dim
    out, bias = np.zeros((shape.dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    docs = []
    for t, y in zip(texts, labels):
        ws = words_of(t, shape.lower)
        ids, _, hashes = features(ws, shape)
        if shape.pairs:
            ids = np.concatenate([ids, pair_features(hashes, shape)])
        ids, n = np.unique(ids, return_counts=True)
        docs.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32), classes.index(y)))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share, y = docs[k]
            lr = rate * (1 - done / steps) * (weights or {}).get(classes[y], 1.0)
            done += 1
            h = share @ emb[ids]
            g = softmax(h @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= lr * np.outer(h, g)
            bias -= np.float32(lr * 0.1) * g
            emb[ids] -= lr * len(ids) ** 0.5 * share[:, None] * back
    return Model(shape, classes, emb @ out, bias.astype(np.float64))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 200, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for P(y) = 1 / (1 + exp(-(x w))) ; x has a column of ones."""
    w = np.zeros(x.shape[1])
    s = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (s * (p - y)) + ridge * w
        hess = (x * (s * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
