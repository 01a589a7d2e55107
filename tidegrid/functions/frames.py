"""Numpy functions of frames: grey crops and dense motion between two of them."""

from __future__ import annotations

import numpy as np

# Weights of blue, green and red in 1 / 2 ** 14, and the settings of the motion estimate.
GREY = (1868, 9617, 4899)
LEVELS, SHRINK, WINDOW, ITERATIONS, REACH, SIGMA = 3, 0.5, 15, 3, 5, 1.2


def area_weights(source: int, target: int) -> np.ndarray:
    """[target, source]: the share of each source pixel in each target pixel."""
    edge = np.arange(target + 1) * source / target
    low, high = np.maximum(edge[:-1, None], np.arange(source)), np.minimum(edge[1:, None], np.arange(1, source + 1))
    return np.maximum(high - low, 0) * target / source


def grey_crop(bgr: np.ndarray, box: tuple[int, int, int, int], side: int) -> np.ndarray | None:
    """A box of a frame in grey levels, by areas, as side x side bytes; None for an empty box."""
    x0, y0, x1, y1 = box
    part = bgr[y0:y1, x0:x1].astype(np.int64)
    if not part.size:
        return None
    grey = (part @ np.array(GREY) + (1 << 13)) >> 14
    if grey.shape != (side, side):
        grey = area_weights(grey.shape[0], side) @ grey @ area_weights(grey.shape[1], side).T
    return np.clip(np.rint(grey), 0, 255).astype(np.uint8)


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis; edge values go on outside."""
    half = len(kernel) // 2
    wide = np.pad(x, [(half, half) if k == axis else (0, 0) for k in range(x.ndim)], mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(wide, len(kernel), axis=axis)
    return view @ kernel


def expansion(x: np.ndarray, reach: int = REACH, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """Around each pixel the quadratic that fits best with Gaussian weights: matrix A (xx, yy, xy / 2) and vector b (x, y)."""
    i = np.arange(-reach, reach + 1)
    g = np.exp(-(i**2) / (2 * sigma**2))
    g /= g.sum()
    base = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    mixed = np.array([[(g * i ** (p[0] + q[0])).sum() * (g * i ** (p[1] + q[1])).sum() for q in base] for p in base])
    rows = {k: _along(x, g * i**k, 0) for k in range(3)}
    moments = np.stack([_along(rows[py], g * i**px, 1) for px, py in base], axis=-1)
    r = moments @ np.linalg.inv(mixed).T
    return np.stack([r[..., 3], r[..., 4], r[..., 5] / 2], axis=-1), r[..., 1:3]


def _resize(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear, pixel centres kept in place."""
    at = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip(shape, x.shape)]
    low = [np.floor(v).astype(int) for v in at]
    high = [np.minimum(v + 1, m - 1) for v, m in zip(low, x.shape)]
    (fy, fx) = (v - a for v, a in zip(at, low))
    top = x[low[0]][:, low[1]] * (1 - fx) + x[low[0]][:, high[1]] * fx
    end = x[high[0]][:, low[1]] * (1 - fx) + x[high[0]][:, high[1]] * fx
    return top * (1 - fy[:, None]) + end * fy[:, None]


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    i = np.arange(-max(1, round(2.5 * sigma)), max(1, round(2.5 * sigma)) + 1)
    g = np.exp(-(i**2) / (2 * sigma**2))
    g /= g.sum()
    return _along(_along(x, g, 0), g, 1)


def _at(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Values of an image (row, column, ...) at fractional places inside it, bilinear."""
    y, z = np.floor(rows).astype(int), np.floor(columns).astype(int)
    y1, z1 = np.minimum(y + 1, x.shape[0] - 1), np.minimum(z + 1, x.shape[1] - 1)
    fy, fx = (rows - y)[..., None], (columns - z)[..., None]
    return (x[y, z] * (1 - fx) + x[y, z1] * fx) * (1 - fy) + (x[y1, z] * (1 - fx) + x[y1, z1] * fx) * fy


def pyramid(x: np.ndarray) -> list[np.ndarray]:
    """From the coarsest level to the image itself; each is smoothed for its scale before it is shrunk."""
    out, x = [], x.astype(float)
    for level in range(LEVELS - 1, 0, -1):
        shape = tuple(max(1, round(n * SHRINK**level)) for n in x.shape)
        if min(shape) >= 16:
            out.append(_resize(_smooth(x, (SHRINK**-level - 1) / 2), shape))
    return [*out, x]


def motion(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """[row, column, (x, y)]: where each pixel of one frame went in the next, to fractions of a pixel, by polynomial expansion
    (G. Farneback, Two-frame motion estimation based on polynomial expansion, 2003), from coarse to fine.

    The expansion of the next frame is taken at the places that the motion so far points to, by bilinear interpolation.
    """
    flow = None
    window = np.ones(WINDOW) / WINDOW
    for level_one, level_two in zip(pyramid(one), pyramid(two)):
        shape = level_one.shape
        (a1, b1), (a2, b2) = expansion(level_one), expansion(level_two)
        later = np.concatenate([a2, b2], axis=-1)
        flow = np.zeros((*shape, 2)) if flow is None else np.stack([_resize(flow[..., k], shape) / SHRINK for k in (0, 1)], axis=-1)
        row, col = np.indices(shape)
        for _ in range(ITERATIONS):
            y, x = np.clip(row + flow[..., 1], 0, shape[0] - 1), np.clip(col + flow[..., 0], 0, shape[1] - 1)
            there = _at(later, y, x)
            a = (a1 + there[..., :3]) / 2
            moved = np.stack([x - col, y - row], axis=-1)
            xx, yy, xy = a[..., 0], a[..., 1], a[..., 2]
            d = (b1 - there[..., 3:]) / 2 + np.stack([xx * moved[..., 0] + xy * moved[..., 1], xy * moved[..., 0] + yy * moved[..., 1]], axis=-1)
            normal = np.stack([xx * xx + xy * xy, xy * (xx + yy), yy * yy + xy * xy, xx * d[..., 0] + xy * d[..., 1], xy * d[..., 0] + yy * d[..., 1]], axis=-1)
            g11, g12, g22, h1, h2 = np.moveaxis(_along(_along(normal, window, 0), window, 1), -1, 0)
            det = g11 * g22 - g12 * g12 + 1e-9
            flow = np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det], axis=-1)
    return flow


def block_means(x: np.ndarray, grid: int) -> np.ndarray:
    """Means of grid x grid blocks, row after row; what is left over at the far edges is cropped."""
    n = x.shape[0] // grid
    return x[: grid * n, : grid * n].reshape(grid, n, grid, n).mean(axis=(1, 3)).ravel()
