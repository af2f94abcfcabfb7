"""Product quantiser in numpy: coarse centroids, and codes of the residuals in each subspace."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Centroids of a subspace, subspaces, and rounds of Lloyd's iteration.
CODES, SUBSPACES, ROUNDS = 256, 8, 10
#: Sample rows that the subspaces are fitted on; distances that are held at once.
CODE_ROWS, DISTANCES = 8192, 1 << 22


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each row's nearest centroid, some rows at a time."""
    half, turned = (centroids**2).sum(1) / 2, centroids.T
    step, out = max(1, DISTANCES // len(centroids)), np.empty(len(x), np.int64)
    for at in range(0, len(x), step):
        out[at : at + step] = np.argmin(half - x[at : at + step] @ turned, axis=1)
    return out


def lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids by Lloyd's iteration from k rows drawn with a fixed seed; a centroid that loses its rows stays where it is."""
    centroids = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centroids)
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(counts)
        sums = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[some])
        centroids[some] = sums / counts[some, None]
    return centroids


@dataclass
class Quantiser:
    """centroids: [lists, d]; books: for each subspace its columns' bounds and centroids; without books codes are empty and bound nothing."""

    centroids: np.ndarray
    bounds: list[tuple[int, int]]
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        """From unit vectors, one a row."""
        centroids = lloyd(sample, min(lists, len(sample)), 1)
        some = sample[:CODE_ROWS]
        residual = some - centroids[nearest(some, centroids)]
        edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
        bounds = list(zip(edges[:-1], edges[1:], strict=True))
        return cls(centroids, bounds, [lloyd(residual[:, a:b], min(CODES, len(residual)), 2 + i) for i, (a, b) in enumerate(bounds)])

    @classmethod
    def trivial(cls, d: int) -> Quantiser:
        """One list of everything, compared exactly."""
        return cls(np.zeros((1, d)), [], [])

    def margins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own list, distance to the border between it and each other list); a row's own margin is 0."""
        squares = (self.centroids**2).sum(1) - 2 * (x @ self.centroids.T)
        own = np.argmin(squares, axis=1)
        rows = np.arange(len(x))
        norms = (self.centroids**2).sum(1)
        apart = np.sqrt(np.maximum(norms[own, None] + norms - 2 * (self.centroids[own] @ self.centroids.T), 0))
        out = (squares - squares[rows, own][:, None]) / np.maximum(2 * apart, 1e-12)
        out[rows, own] = 0
        return own, out

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes [n, subspaces] as bytes, length of what the codes leave of each vector)."""
        residual = x - self.centroids[own]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        left = 0.0
        for i, ((a, b), book) in enumerate(zip(self.bounds, self.books, strict=True)):
            codes[:, i] = nearest(residual[:, a:b], book)
            left = left + ((residual[:, a:b] - book[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(left) if self.books else np.full(len(x), np.inf)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances [queries, members] to a list's coded members, by one table of each query and subspace."""
        asked = (queries - self.centroids[at]).astype(np.float32)
        out = np.zeros((len(queries), len(codes)), np.float32)
        for i, ((a, b), book) in enumerate(zip(self.bounds, self.books, strict=True)):
            part, book = asked[:, a:b], book.astype(np.float32)
            table = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * (part @ book.T)
            out += np.take(table, codes[:, i], axis=1)
        return out
