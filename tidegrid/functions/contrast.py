"""Band spectra of waveforms and the contrastive loss between two views, with their gradients."""

from __future__ import annotations

import numpy as np


def _waves(n: int, fs: float, low: float, high: float, nfft: int | None) -> np.ndarray:
    """(bins of the band, n) complex exponentials; both edges belong to the band."""
    size = nfft or n
    k = np.arange(size // 2 + 1)
    k = k[(k * fs / size >= low) & (k * fs / size <= high)]
    return np.exp(-2j * np.pi / size * (k[:, None] * np.arange(min(n, size)) % size))


def band_spectra(waves: np.ndarray, fs: float, low: float, high: float, nfft: int | None = None) -> tuple[np.ndarray, tuple]:
    """Power of each waveform (row) in the band, summing to one, and what ``band_spectra_back`` needs."""
    turns = _waves(waves.shape[1], fs, low, high, nfft)
    x = (waves - waves.mean(axis=1, keepdims=True))[:, : turns.shape[1]] @ turns.T
    power = x.real**2 + x.imag**2
    total = power.sum(axis=1, keepdims=True) + 1e-12
    return power / total, (x, power / total, total, turns, waves.shape[1])


def band_spectra_back(dshare: np.ndarray, held: tuple) -> np.ndarray:
    x, share, total, turns, n = held
    dpower = (dshare - (dshare * share).sum(axis=1, keepdims=True)) / total
    dw = np.zeros((len(x), n))
    dw[:, : turns.shape[1]] = ((2 * dpower * x) @ turns.conj()).real
    return dw - dw.mean(axis=1, keepdims=True)


def info_nce(a: np.ndarray, b: np.ndarray, tau: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Symmetric loss of a batch and its gradients by both views; likeness is the negative mean squared difference over tau.

    Every other item, in either view, is a negative; an item's own views are left out of the denominator.
    """
    n, width = a.shape
    like = lambda x, y: -((x[:, None] - y[None]) ** 2).mean(axis=2) / tau
    own = np.eye(n, dtype=bool)
    loss, grads = 0.0, {"a": np.zeros_like(a), "b": np.zeros_like(b)}
    for (p, x), (q, y) in ((("a", a), ("b", b)), (("b", b), ("a", a))):
        same, other = like(x, x), like(x, y)
        every = np.concatenate([np.where(own, -np.inf, same), np.where(own, -np.inf, other)], axis=1)
        top = every.max(axis=1, keepdims=True)
        share = np.exp(every - top)
        rest = share.sum(axis=1, keepdims=True)
        loss += float((np.log(rest[:, 0]) + top[:, 0] - other.diagonal()).mean()) / 2
        share /= rest * 2 * n
        for (r, u), d in (((p, x), share[:, :n]), ((q, y), share[:, n:] - np.eye(n) / (2 * n))):
            scale = 2 / (width * tau)
            grads[p] -= scale * (x * d.sum(axis=1)[:, None] - d @ u)
            grads[r] -= scale * (u * d.sum(axis=0)[:, None] - d.T @ x)
    return loss, grads["a"], grads["b"]
