"""Coarse quantizers of inverted files: which lists a vector belongs to and which a query probes."""

from __future__ import annotations

import numpy as np

from ranklore.operators import codecs as Q

#: Lists of a composed quantizer are numbered and held as one table of centroids; more are an error.
MAX_LISTS = 1 << 20
_TILE = 1 << 24


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0.0)


class FlatCoarse:
    """A table of centroids, compared one and all."""

    def __init__(self, lists: int = 0, iterations: int = 8, centroids: np.ndarray | None = None):
        self.lists, self.iterations = lists, iterations
        self.centroids = None if centroids is None else np.asarray(centroids, np.float64)

    def fit(self, sample: np.ndarray) -> FlatCoarse:
        if self.centroids is None:
            self.centroids = Q.lloyd(sample, self.lists, self.iterations)
        self.lists = len(self.centroids)
        return self

    def top(self, x: np.ndarray, n: int) -> np.ndarray:
        """(rows, n) numbers of the nearest lists, nearest first; ties go to the lower number."""
        step = max(1, _TILE // max(1, len(self.centroids)))
        out = [np.argsort(_squared(x[i : i + step], self.centroids), axis=1, kind="stable")[:, :n] for i in range(0, len(x), step)]
        return np.concatenate(out) if out else np.empty((0, min(n, self.lists)), np.int64)


class AdditiveCoarse(FlatCoarse):
    """Lists are all sums of one word of each codebook of an additive codec (residual or locally
    searched). ``beam`` bounds a probe's search to the best partial sums, ``beam`` for each list
    asked for; 0 compares with all lists."""

    def __init__(self, codec, beam: int = 0):
        super().__init__()
        self.codec, self.beam = codec, beam

    def fit(self, sample):
        self.codec.fit(sample)
        sizes = [len(b) for b in self.codec.codebooks]
        if np.prod(sizes) > MAX_LISTS:
            raise ValueError(f"more than {MAX_LISTS} lists")
        total = np.zeros((1, sample.shape[1]))
        for book in self.codec.codebooks:  # the first codebook counts most in a list's number
            total = (total[:, None, :] + book[None]).reshape(-1, sample.shape[1])
        self.centroids, self.lists = total, len(total)
        return self

    def top(self, x, n):
        if not self.beam:
            return super().top(x, n)
        width, rows = n * self.beam, np.arange(len(x))[:, None]
        number, partial = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1, x.shape[1]))
        for book in self.codec.codebooks:
            d = ((x[:, None, None, :] - partial[:, :, None, :] - book[None, None]) ** 2).sum(-1).reshape(len(x), -1)
            best = np.argsort(d, axis=1, kind="stable")[:, : min(width, d.shape[1])]
            parent, word = best // len(book), best % len(book)
            number = number[rows, parent] * len(book) + word
            partial = partial[rows, parent] + book[word]
        return number[:, :n]


class MultiIndexCoarse(FlatCoarse):
    """Lists are all pairs (triples, ...) of a product codec's words: an inverted multi-index. A list's
    distance is the sum over the subspaces, so all are ranked from a few small tables."""

    def __init__(self, parts: int = 2, bits: int = 3):
        super().__init__()
        self.codec = Q.Product(parts, bits)

    def fit(self, sample):
        self.codec.fit(sample)
        books = self.codec.codebooks
        if np.prod([len(b) for b in books]) > MAX_LISTS:
            raise ValueError(f"more than {MAX_LISTS} lists")
        total = np.zeros((1, 0))
        for book in books:
            total = np.concatenate([np.repeat(total, len(book), 0), np.tile(book, (len(total), 1))], 1)
        self.centroids, self.lists = total, len(total)
        return self

    def top(self, x, n):
        total = np.zeros((len(x), 1))
        for part, book in zip(np.split(x, len(self.codec.codebooks), axis=1), self.codec.codebooks, strict=True):
            total = (total[:, :, None] + _squared(part, book)[:, None, :]).reshape(len(x), -1)
        return np.argsort(total, axis=1, kind="stable")[:, :n]
