"""Eigendecomposition of a scatter matrix that grows: rank-one updates by the secular equation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps
_HALF = 1 << 26  # sums are kept in two parts, so that they stay exact


def _deflate(d: np.ndarray, q: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Positions that the update changes; z is made zero elsewhere, for equal eigenvalues by rotating their vectors."""
    size = np.sqrt(z @ z)
    tolerance = 8 * _EPS * max(np.abs(d).max(), size * size)
    z[np.abs(z) * size <= tolerance] = 0
    kept: list[int] = []
    for j in np.flatnonzero(z).tolist():
        if kept:
            i = kept[-1]
            length = np.hypot(z[i], z[j])
            c, s = z[j] / length, z[i] / length
            if abs((d[j] - d[i]) * c * s) <= tolerance:
                a, b = q[:, i].copy(), q[:, j]
                q[:, i], q[:, j] = c * a - s * b, s * a + c * b
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                z[i], z[j] = 0, length
                kept.pop()
        kept.append(j)
    return np.array(kept, int)


def _differences(d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """d[j] - root[i] for the roots of 1 + sum z^2 / (d - root), each exact to the last place or so.

    A root is sought from the nearer of its two poles, by halving the range of floating-point numbers themselves.
    """
    k, squares = len(d), z * z
    reach = np.append(np.diff(d), squares.sum())
    middle = reach / 2
    left = 1 + (squares / (d[None, :] - d[:, None] - middle[:, None])).sum(axis=1) >= 0
    left[-1] = True
    origin = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    middle[-1] = reach[-1]
    sign, delta = np.where(left, 1.0, -1.0), d[None, :] - d[origin][:, None]
    low, high = np.full(k, np.finfo(float).tiny).view(np.int64), np.nextafter(middle, np.inf).view(np.int64)
    for _ in range(64):
        at = low + (high - low) // 2
        away = at.view(float) * sign
        with np.errstate(divide="ignore", over="ignore"):
            above = (1 + (squares / (delta - away[:, None])).sum(axis=1) >= 0) == left
        low, high = np.where(above, low, at), np.where(above, at, high)
    return delta - (high.view(float) * sign)[:, None]


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and vectors (columns) of q diag(d) q' + v v'."""
    d, q, z = d.copy(), q.copy(), q.T @ v
    if not z.any():
        return d, q
    own = _deflate(d, q, z)
    if len(own):
        order = own[np.argsort(d[own], kind="stable")]
        poles, y = d[order], z[order]
        apart = _differences(poles, y)  # [root, pole]
        k = len(order)
        # the z for which these roots are exact keeps the vectors orthogonal
        ratio = np.empty((k, k))  # [root, pole]
        gap = poles[:, None] - poles[None, :]
        lower, upper = np.tril_indices(k, -1), np.triu_indices(k)
        ratio[lower[1], lower[0]] = -apart[lower[1], lower[0]] / gap[lower[1], lower[0]]
        beyond = np.vstack([gap[1:], np.ones(k)])  # of root i the pole above it, the last alone
        ratio[upper[1], upper[0]] = -apart[upper[1], upper[0]] / beyond[upper[1], upper[0]]
        exact = np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(y)
        vectors = exact[None, :] / apart
        vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        d[order] = poles - apart.diagonal()
        q[:, order] = q[:, order] @ vectors.T
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Number and exact sums of vectors of integers, and the spectrum of their scatter about their mean."""

    n: int
    high: np.ndarray  # sums of the parts above and below 2 ** 26
    low: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width), np.eye(width))

    @property
    def mean(self) -> np.ndarray:
        return (self.high.astype(float) * _HALF + self.low) / max(self.n, 1)

    def sums(self) -> list[int]:
        return [h * _HALF + x for h, x in zip(self.high.tolist(), self.low.tolist())]

    def _add(self, n: int, high: np.ndarray, low: np.ndarray, factor: np.ndarray) -> None:
        """Of n further vectors: their sums, and rows whose scatter about zero is theirs about their mean."""
        shift = (high.astype(float) * _HALF + low) / n - self.mean
        updates = [*factor, shift * np.sqrt(self.n / (self.n + n) * n)] if self.n else list(factor)
        for v in updates:
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.n, self.high, self.low = self.n + n, self.high + high, self.low + low

    def add_rows(self, x: np.ndarray) -> None:
        """Rows of integers; the triangular factor of the centred rows has their scatter in as many rows as columns."""
        high = (x // _HALF).sum(axis=0)
        low = (x % _HALF).sum(axis=0)
        centred = x - (high.astype(float) * _HALF + low) / len(x)
        self._add(len(x), high, low, np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred)

    def add(self, other: Spectrum) -> None:
        if other.n:
            self._add(other.n, other.high, other.low, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def state(self) -> tuple[bytes, bytes]:
        return np.concatenate([[self.n], self.high, self.low]).astype("<i8").tobytes(), np.concatenate([self.values, self.vectors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def of(cls, whole: bytes, real: bytes) -> Spectrum:
        a, b = np.frombuffer(whole, "<i8"), np.frombuffer(real, "<f8")
        width = len(a) // 2
        return cls(int(a[0]), a[1 : width + 1], a[width + 1 :], b[:width], b[width:].reshape(width, width))
