"""Vector codecs: trained on a bounded sample, applied to Arrow batches.

A codec has ``fit(sample)``, ``encode(x)`` to a (rows, width) uint8 matrix and
``decode(codes)`` back to vectors. All are small NumPy models, sent as broadcasts.
"""

from __future__ import annotations

import numpy as np


def lloyd(x: np.ndarray, k: int, iterations: int = 15, seed: int = 0) -> np.ndarray:
    """k-means of a sample in memory; empty clusters take a copy of the largest, moved a little."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    if len(x) < k:
        x = np.concatenate([x, x[rng.integers(0, len(x), k - len(x))] + rng.normal(0, 1e-6, (k - len(x), x.shape[1]))])
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(iterations):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        held = counts > 0
        c[held] = total[held] / counts[held, None]
        for i in np.flatnonzero(~held):
            c[i] = c[counts.argmax()] * (1 + 1 / 1024)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (c * c).sum(1)[None, :] - 2 * x @ c.T
    return d.argmin(1)


class Flat:
    """Uncompressed 32-bit floats."""

    def fit(self, x):
        self.dim = x.shape[1]
        return self

    def encode(self, x):
        return np.ascontiguousarray(x, np.float32).view(np.uint8).reshape(len(x), -1)

    def decode(self, codes):
        return np.ascontiguousarray(codes).view(np.float32).astype(np.float64)


class HalfFloat(Flat):
    """fp16, or bf16 (the upper half of a 32-bit float, rounded to even)."""

    def __init__(self, brain: bool = False):
        self.brain = brain

    def encode(self, x):
        if not self.brain:
            return np.ascontiguousarray(x, np.float16).view(np.uint8).reshape(len(x), -1)
        bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
        rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16
        return rounded.astype(np.uint16).view(np.uint8).reshape(len(x), -1)

    def decode(self, codes):
        half = np.ascontiguousarray(codes).view(np.uint16)
        if not self.brain:
            return half.view(np.float16).astype(np.float64)
        return (half.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


class Scalar:
    """Per-dimension (or ``uniform``) affine codes of 4, 6 or 8 bits; ``direct`` stores bytes as they are."""

    def __init__(self, bits: int = 8, uniform: bool = False, direct: bool = False):
        if bits not in (4, 6, 8):
            raise ValueError("scalar codes have 4, 6 or 8 bits")
        self.bits, self.uniform, self.direct = bits, uniform, direct

    def fit(self, x):
        self.low, high = x.min(0), x.max(0)
        if self.uniform:
            self.low, high = np.full_like(self.low, x.min()), np.full_like(high, x.max())
        self.span = np.where(high > self.low, high - self.low, 1.0)
        return self

    def encode(self, x):
        if self.direct:
            return np.clip(x, 0, 255).astype(np.uint8)
        top = (1 << self.bits) - 1
        return np.clip(np.floor((x - self.low) / self.span * top + 0.5), 0, top).astype(np.uint8)

    def decode(self, codes):
        if self.direct:
            return codes.astype(np.float64)
        return codes / ((1 << self.bits) - 1) * self.span + self.low


class RowwiseMinMax:
    """Each row scaled by its own least and greatest entry (kept as floats), then 8-bit codes."""

    def fit(self, x):
        self.dim = x.shape[1]
        return self

    def encode(self, x):
        low, high = x.min(1, keepdims=True).astype(np.float32), x.max(1, keepdims=True).astype(np.float32)
        span = np.where(high > low, high - low, 1).astype(np.float64)
        codes = np.clip(np.floor((x - low) / span * 255 + 0.5), 0, 255).astype(np.uint8)
        ends = np.concatenate([low, high], 1).view(np.uint8).reshape(len(x), -1)
        return np.concatenate([ends, codes], 1)

    def decode(self, codes):
        ends = np.ascontiguousarray(codes[:, :8]).view(np.float32).astype(np.float64)
        low, high = ends[:, :1], ends[:, 1:]
        return codes[:, 8:] / 255.0 * np.where(high > low, high - low, 1) + low


class Product:
    """Product quantizer: the nearest codeword of each of ``m`` subspaces."""

    def __init__(self, m: int = 8, bits: int = 8, codebooks: np.ndarray | None = None):
        self.m, self.bits, self.codebooks = m, bits, codebooks

    def _parts(self, x):
        if x.shape[1] % self.m:
            raise ValueError("the dimension must be a multiple of the number of subspaces")
        return x.reshape(len(x), self.m, -1)

    def fit(self, x):
        parts = self._parts(np.asarray(x, np.float64))
        self.codebooks = np.stack([lloyd(parts[:, i], 1 << self.bits, seed=i) for i in range(self.m)])
        return self

    def encode(self, x):
        parts = self._parts(np.asarray(x, np.float64))
        return np.stack([nearest(parts[:, i], self.codebooks[i]) for i in range(self.m)], 1).astype(np.uint8)

    def decode(self, codes):
        return np.concatenate([self.codebooks[i][codes[:, i]] for i in range(self.m)], 1)


class Residual:
    """Additive quantizer: ``m`` rounds, each codes what the rounds before left over."""

    def __init__(self, m: int = 4, bits: int = 6, beam: int = 4):
        self.m, self.bits, self.beam = m, bits, beam

    def fit(self, x):
        rest, self.codebooks = np.asarray(x, np.float64).copy(), []
        for i in range(self.m):
            book = lloyd(rest, 1 << self.bits, seed=i)
            self.codebooks.append(book)
            rest -= book[nearest(rest, book)]
        return self

    def encode(self, x):
        x = np.asarray(x, np.float64)
        n = len(x)
        codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
        for book in self.codebooks:
            d = ((rest[:, :, None, :] - book[None, None]) ** 2).sum(-1)
            width = d.shape[1]
            keep = min(self.beam, width * len(book))
            best = np.argsort(d.reshape(n, -1), axis=1, kind="stable")[:, :keep]
            parent, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, parent], word[..., None].astype(np.uint8)], -1)
            rest = rest[rows, parent] - book[word]
        return codes[:, 0]

    def decode(self, codes):
        return sum(book[codes[:, i]] for i, book in enumerate(self.codebooks))


class LocalSearch(Residual):
    """Additive quantizer whose codebooks are refitted together and whose codes are improved one
    place at a time until nothing changes."""

    def __init__(self, m: int = 4, bits: int = 6, rounds: int = 3):
        super().__init__(m, bits, 1)
        self.rounds = rounds

    def fit(self, x):
        super().fit(x)
        x = np.asarray(x, np.float64)
        size = 1 << self.bits
        for _ in range(self.rounds):
            codes = self.encode(x)
            design = np.zeros((len(x), self.m * size))
            for i in range(self.m):
                design[np.arange(len(x)), i * size + codes[:, i].astype(np.int64)] = 1.0
            gram = design.T @ design + 1e-3 * np.eye(self.m * size)
            books = np.linalg.solve(gram, design.T @ x)
            self.codebooks = [books[i * size : (i + 1) * size] for i in range(self.m)]
        return self

    def encode(self, x):
        x = np.asarray(x, np.float64)
        codes = super().encode(x)
        for _ in range(4):
            before = codes.copy()
            for i, book in enumerate(self.codebooks):
                others = self.decode(codes) - book[codes[:, i]]
                codes[:, i] = nearest(x - others, book)
            if (codes == before).all():
                break
        return codes


class ProductAdditive:
    """An additive quantizer in each of ``splits`` subspaces."""

    def __init__(self, splits: int = 2, m: int = 2, bits: int = 6, local_search: bool = False):
        self.parts = [LocalSearch(m, bits) if local_search else Residual(m, bits) for _ in range(splits)]

    def fit(self, x):
        for part, sub in zip(self.parts, np.array_split(x, len(self.parts), axis=1), strict=True):
            part.fit(sub)
        return self

    def encode(self, x):
        return np.concatenate([p.encode(s) for p, s in zip(self.parts, np.array_split(x, len(self.parts), axis=1), strict=True)], 1)

    def decode(self, codes):
        return np.concatenate([p.decode(c) for p, c in zip(self.parts, np.array_split(codes, len(self.parts), axis=1), strict=True)], 1)


def rotation(dim: int, seed: int = 0, out: int | None = None) -> np.ndarray:
    """(out, dim) rows of a random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(dim, out or dim), max(dim, out or dim))))
    return (q * np.sign(np.diag(r)))[: out or dim, :dim]


class RotatedSigns:
    """Sign bits after a random rotation about the mean, with the two factors that undo the scale:
    the length of the centred vector and its product with the sign vector."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit(self, x):
        self.mean = x.mean(0)
        self.matrix = rotation(x.shape[1], self.seed)
        return self

    def encode(self, x):
        r = (x - self.mean) @ self.matrix.T
        signs = r >= 0
        length = np.linalg.norm(r, axis=1)
        inner = np.abs(r).sum(1) / np.sqrt(r.shape[1]) / np.where(length > 0, length, 1)
        extra = np.stack([length, inner], 1).astype(np.float32).view(np.uint8).reshape(len(x), -1)
        return np.concatenate([extra, np.packbits(signs, axis=1, bitorder="little")], 1)

    def decode(self, codes):
        dim = len(self.mean)
        extra = np.ascontiguousarray(codes[:, :8]).view(np.float32).astype(np.float64)
        bits = np.unpackbits(codes[:, 8:], axis=1, count=dim, bitorder="little") * 2.0 - 1.0
        scale = extra[:, :1] / np.where(extra[:, 1:] > 0, extra[:, 1:], 1) / np.sqrt(dim)
        return bits * scale @ self.matrix + self.mean

    def _estimate(self, rotated: np.ndarray, inner: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances from the rotated queries' products with the signs: the two factors make
        the product with the vector itself unbiased, and both lengths are known exactly."""
        extra = np.ascontiguousarray(codes[:, :8]).view(np.float32).astype(np.float64)
        length, along = extra[:, 0], np.where(extra[:, 1] > 0, extra[:, 1], 1)
        product = inner * (length / along / np.sqrt(rotated.shape[1]))[None, :]
        return np.maximum((rotated * rotated).sum(1)[:, None] + (length * length)[None, :] - 2 * product, 0.0)

    def distances(self, queries, codes):
        r = (queries - self.mean) @ self.matrix.T
        bits = np.unpackbits(codes[:, 8:], axis=1, count=r.shape[1], bitorder="little") * 2.0 - 1.0
        return self._estimate(r, r @ bits.T, codes)


class SignHash:
    """Bits of (rotated) projections against zero or their medians; compared by Hamming distance."""

    def __init__(self, bits: int = 64, rotate: bool = True, medians: bool = False, seed: int = 0):
        self.bits, self.rotate, self.medians, self.seed = bits, rotate, medians, seed

    def _project(self, x):
        return x @ self.matrix.T if self.rotate else x[:, : self.bits]

    def fit(self, x):
        if self.rotate:
            self.matrix = rotation(x.shape[1], self.seed, self.bits)
        p = self._project(np.asarray(x, np.float64))
        self.cut = np.median(p, 0) if self.medians else np.zeros(p.shape[1])
        return self

    def encode(self, x):
        return np.packbits(self._project(np.asarray(x, np.float64)) >= self.cut, axis=1, bitorder="little")

    def distances(self, queries, codes):
        """Hamming distances of the queries' bits to the rows'."""
        a = np.unpackbits(self.encode(queries), axis=1, bitorder="little").astype(np.float32)
        b = np.unpackbits(codes, axis=1, bitorder="little").astype(np.float32)
        return (a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * a @ b.T).astype(np.float64)


class SpectralHash(SignHash):
    """Bits that alternate along each projection with a period, after centring; compared by Hamming distance."""

    def __init__(self, bits: int = 64, period: float = 1.0, seed: int = 0):
        super().__init__(bits, True, False, seed)
        self.period = period

    def encode(self, x):
        p = self._project(np.asarray(x, np.float64)) - self.cut
        return np.packbits(np.floor(p * 2 / self.period).astype(np.int64) & 1, axis=1, bitorder="little")


class Lattice:
    """Nearest point of squared norm ``r2`` of the integer lattice, for the direction; the length is kept."""

    def __init__(self, r2: int = 24):
        self.r2 = r2

    def fit(self, x):
        return self

    def encode(self, x):
        x = np.asarray(x, np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.abs(x / np.where(length > 0, length, 1)) * np.sqrt(self.r2)
        points = np.zeros_like(x, np.int64)
        left = np.full(len(x), self.r2)
        for _ in range(self.r2):  # grow the coordinate that gains most while the norm allows it
            step = 2 * points + 1
            gain = np.where(step <= left[:, None], unit - points - 0.5, -np.inf)
            at = gain.argmax(1)
            rows = np.flatnonzero(np.isfinite(gain[np.arange(len(x)), at]))
            if not len(rows):
                break
            left[rows] -= step[rows, at[rows]]
            points[rows, at[rows]] += 1
        signed = (points * np.where(x < 0, -1, 1)).astype(np.int8).view(np.uint8)
        return np.concatenate([length.astype(np.float32).view(np.uint8).reshape(len(x), -1), signed], 1)

    def decode(self, codes):
        length = np.ascontiguousarray(codes[:, :4]).view(np.float32).astype(np.float64)
        points = np.ascontiguousarray(codes[:, 4:]).view(np.int8).astype(np.float64)
        norm = np.linalg.norm(points, axis=1, keepdims=True)
        return points / np.where(norm > 0, norm, 1) * length


class TwoLayer:
    """A coarse centroid's number and a fine code of what is left over."""

    def __init__(self, coarse: int = 16, fine=None):
        self.coarse, self.fine = coarse, fine or Product(8, 6)

    def fit(self, x):
        self.centroids = lloyd(x, self.coarse)
        self.fine.fit(x - self.centroids[nearest(x, self.centroids)])
        return self

    def encode(self, x):
        near = nearest(x, self.centroids)
        head = near.astype(np.uint32)[:, None].view(np.uint8).reshape(len(x), 4)
        return np.concatenate([head, self.fine.encode(x - self.centroids[near])], 1)

    def decode(self, codes):
        near = np.ascontiguousarray(codes[:, :4]).view(np.uint32)[:, 0]
        return self.fine.decode(codes[:, 4:]) + self.centroids[near]


# distances from codes


def code_distances(codec, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, rows) squared distances as the codec estimates them; by decoding where it has no way of its own."""
    own = getattr(codec, "distances", None)
    if own is not None:
        return own(queries, codes)
    x = codec.decode(codes)
    d = (queries * queries).sum(1)[:, None] - 2 * queries @ x.T + (x * x).sum(1)[None, :]
    return np.maximum(d, 0.0)


class Refining:
    """A second code for what the first leaves over; distances are those of the sum of both."""

    def __init__(self, first, second):
        self.first, self.second, self.width = first, second, 0

    def fit(self, x):
        self.first.fit(x)
        codes = self.first.encode(x)
        self.width = codes.shape[1]
        self.second.fit(x - self.first.decode(codes))
        return self

    def encode(self, x):
        codes = self.first.encode(x)
        return np.concatenate([codes, self.second.encode(x - self.first.decode(codes))], 1)

    def decode(self, codes):
        return self.first.decode(codes[:, : self.width]) + self.second.decode(codes[:, self.width :])


def _nibbles(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte, the first in the low half."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def _from_nibbles(packed: np.ndarray, count: int) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :count]


def scanned(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries, (queries, rows), of ``tables`` (queries, places, 16) at ``codes`` (rows, places).

    Entries are brought to 8 bits a query, from the least of each place, with one scale for
    all places; sums run in 16 bits and are scaled back, as in 4-bit scans."""
    low = tables.min(2, keepdims=True)
    span = (tables - low).max((1, 2), keepdims=True)
    step = np.where(span > 0, span / 255, 1.0)
    small = np.floor((tables - low) / step + 0.5).astype(np.uint16)
    total = np.zeros((len(tables), len(codes)), np.uint16 if tables.shape[1] <= 256 else np.uint32)
    for place in range(tables.shape[1]):
        total += small[:, place][:, codes[:, place]]
    return total * step[:, 0] + low.sum(1)


class FastProduct(Product):
    """Product codes of 4 bits, two a byte, compared through small 8-bit tables."""

    def __init__(self, m: int = 8):
        super().__init__(m, 4)

    def encode(self, x):
        return _nibbles(super().encode(x))

    def decode(self, codes):
        return super().decode(_from_nibbles(codes, self.m))

    def distances(self, queries, codes):
        parts = self._parts(np.asarray(queries, np.float64))
        tables = ((parts[:, :, None, :] - self.codebooks[None]) ** 2).sum(-1)
        return np.maximum(scanned(tables, _from_nibbles(codes, self.m)), 0.0)


class FastAdditive:
    """An additive codec with codebooks of 16 words, two codes a byte, and the squared length of the
    decoded vector; inner products come from small 8-bit tables."""

    def __init__(self, inner):
        self.inner = inner

    def fit(self, x):
        self.inner.fit(x)
        return self

    def _books(self) -> list[tuple[int, int, np.ndarray]]:
        """First and last dimension and words of each codebook."""
        parts = getattr(self.inner, "parts", None)
        if parts is None:
            return [(0, self.inner.codebooks[0].shape[1], b) for b in self.inner.codebooks]
        out, at = [], 0
        for part in parts:
            wide = part.codebooks[0].shape[1]
            out += [(at, at + wide, b) for b in part.codebooks]
            at += wide
        return out

    def encode(self, x):
        codes = self.inner.encode(x)
        decoded = self.inner.decode(codes)
        lengths = (decoded * decoded).sum(1).astype(np.float32)[:, None].view(np.uint8)
        return np.concatenate([lengths, _nibbles(codes)], 1)

    def decode(self, codes):
        return self.inner.decode(_from_nibbles(codes[:, 4:], len(self._books())))

    def distances(self, queries, codes):
        books = self._books()
        tables = np.stack([queries[:, a:b] @ words.T for a, b, words in books], 1)
        lengths = np.ascontiguousarray(codes[:, :4]).view(np.float32)[:, 0].astype(np.float64)
        inner = scanned(tables, _from_nibbles(codes[:, 4:], len(books)))
        return np.maximum((queries * queries).sum(1)[:, None] - 2 * inner + lengths[None, :], 0.0)


class FastRotatedSigns(RotatedSigns):
    """Rotated sign bits compared four at a time: a table of 16 sign patterns for each run of four."""

    def distances(self, queries, codes):
        r = (queries - self.mean) @ self.matrix.T
        dim = r.shape[1]
        wide = np.concatenate([r, np.zeros((len(r), -dim % 8))], 1)
        signs = np.where(np.arange(16)[:, None] >> np.arange(4) & 1, 1.0, -1.0)
        tables = wide.reshape(len(r), -1, 4) @ signs.T
        inner = scanned(tables, _from_nibbles(codes[:, 8:], tables.shape[1]))
        return self._estimate(r, inner, codes)


class MinMaxHalf(RowwiseMinMax):
    """Row-wise scaling with the two ends kept in 16 bits."""

    def encode(self, x):
        low = np.floor(x.min(1, keepdims=True).astype(np.float64) * 1024) / 1024
        high = np.ceil(x.max(1, keepdims=True).astype(np.float64) * 1024) / 1024
        ends = np.concatenate([low, high], 1).astype(np.float16)
        low, high = ends[:, :1].astype(np.float64), ends[:, 1:].astype(np.float64)
        codes = np.clip(np.floor((x - low) / np.where(high > low, high - low, 1) * 255 + 0.5), 0, 255).astype(np.uint8)
        return np.concatenate([ends.view(np.uint8).reshape(len(x), -1), codes], 1)

    def decode(self, codes):
        ends = np.ascontiguousarray(codes[:, :4]).view(np.float16).astype(np.float64)
        low, high = ends[:, :1], ends[:, 1:]
        return codes[:, 4:] / 255.0 * np.where(high > low, high - low, 1) + low


class SignBits:
    """Vectors of -1 and 1 as bits."""

    def __init__(self, bits: int):
        self.bits = bits

    def fit(self, x):
        return self

    def encode(self, x):
        return np.packbits(np.asarray(x) >= 0, axis=1, bitorder="little")

    def decode(self, codes):
        return np.unpackbits(codes, axis=1, count=self.bits, bitorder="little") * 2.0 - 1.0
