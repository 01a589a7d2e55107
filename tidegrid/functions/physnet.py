"""A two-dimensional convolutional network from maps (channels x time) to waveforms, in numpy: forward and gradients.

Activations are (batch, channels, time, features).  Normalisation takes the batch's own mean and variance in training and
running ones in scoring; they are kept among the weights as ``<layer>.mean`` and ``<layer>.var``.
"""

from __future__ import annotations

import numpy as np

#: Widths, steps from map to features, momentum and constant of the normalisation.
STEM, WIDTH = 32, 64
STEPS: tuple[tuple, ...] = (
    ("block", "stem"),
    ("pool", 2, 1), ("block", "s1a"), ("block", "s1b"),
    ("pool", 2, 1), ("block", "s2a"), ("block", "s2b"),
    ("pool", 2, 2), ("block", "mid_a"), ("block", "mid_b"),
    ("pool", 2, 1), ("block", "s3a"), ("block", "s3b"),
    ("stretch",), ("block", "up"),
)
KERNELS = {"stem": (1, 5), "up": (3, 1)}
MOMENTUM, EPS = 0.1, 1e-5
LEAST_CHANNELS = 16
_RUNNING = (".mean", ".var")

Weights = dict[str, np.ndarray]


def weights(seed: int = 0, out: int = 1, stem: int = STEM, width: int = WIDTH, kind: type = np.float32) -> Weights:
    """Uniform within 1 / sqrt(inputs of a unit); unit gains, zero shifts, unit running statistics."""
    rng, found, cin = np.random.default_rng(seed), {}, 1
    for name in [s[1] for s in STEPS if s[0] == "block"] + ["head"]:
        cout = {"stem": stem, "head": out}.get(name, width)
        a, b = (1, 1) if name == "head" else KERNELS.get(name, (3, 3))
        bound = 1 / np.sqrt(cin * a * b)
        found[f"{name}.w"] = rng.uniform(-bound, bound, (cout, cin, a, b)).astype(kind)
        found[f"{name}.b"] = rng.uniform(-bound, bound, cout).astype(kind)
        if name != "head":
            found |= {f"{name}.{k}": np.full(cout, v, kind) for k, v in (("gain", 1), ("shift", 0), ("mean", 0), ("var", 1))}
        cin = cout
    return found


def trainable(found: Weights) -> list[str]:
    """Names of what training changes by its gradient, in order."""
    return sorted(k for k in found if not k.endswith(_RUNNING))


def n_parameters(found: Weights) -> int:
    return sum(found[k].size for k in trainable(found))


def _padded(x: np.ndarray, kr: int, kc: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (kr // 2, kr // 2), (kc // 2, kc // 2), (0, 0)))


def _convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each place of the kernel is one product with a shifted view of all maps, so no patches are copied out."""
    _, m, t, _ = x.shape
    _, _, kr, kc = w.shape
    wide, y = _padded(x, kr, kc), np.broadcast_to(b, (*x.shape[:3], len(b))).copy()
    for i in range(kr):
        for j in range(kc):
            y += wide[:, i : i + m, j : j + t] @ w[:, :, i, j].T
    return y


def _convolve_back(dy: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the input, the kernel and the bias."""
    _, m, t, c = x.shape
    o, _, kr, kc = w.shape
    wide, dw, flat = _padded(x, kr, kc), np.empty_like(w), dy.reshape(-1, o)
    dwide = np.zeros_like(wide)
    for i in range(kr):
        for j in range(kc):
            dw[:, :, i, j] = flat.T @ wide[:, i : i + m, j : j + t].reshape(-1, c)
            dwide[:, i : i + m, j : j + t] += dy @ w[:, :, i, j]
    return dwide[:, kr // 2 : kr // 2 + m, kc // 2 : kc // 2 + t], dw, flat.sum(axis=0)


def _pool(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    b, m, t, c = x.shape
    return x[:, : m // rows * rows, : t // columns * columns].reshape(b, m // rows, rows, t // columns, columns, c).mean(axis=(2, 4))


def _pool_back(dy: np.ndarray, shape: tuple[int, ...], rows: int, columns: int) -> np.ndarray:
    dx = np.zeros(shape, dy.dtype)
    spread = np.repeat(np.repeat(dy, rows, axis=1), columns, axis=2) / (rows * columns)
    dx[:, : spread.shape[1], : spread.shape[2]] = spread
    return dx


def _stretching(n: int, length: int, kind: np.dtype) -> np.ndarray:
    """Matrix (length x n) of linear interpolation with sample centres aligned."""
    s = np.clip((np.arange(length) + 0.5) * n / length - 0.5, 0, n - 1)
    a = np.floor(s).astype(int)
    found = np.zeros((length, n), kind)
    found[np.arange(length), a] = 1 - (s - a)
    found[np.arange(length), np.minimum(a + 1, n - 1)] += (s - a).astype(kind)
    return found


def run(x: np.ndarray, found: Weights, train: bool = False) -> tuple[np.ndarray, list]:
    """Waveforms (batch, outputs, T) of maps (batch, M, T), M >= 16, and what ``back`` and ``batch_statistics`` need of it."""
    kind, t, tape = found["head.w"].dtype, x.shape[2], []
    h = x[..., None].astype(kind)
    for step in STEPS:
        if step[0] == "pool":
            tape.append((step, h.shape))
            h = _pool(h, *step[1:])
        elif step[0] == "stretch":
            tape.append((step, s := _stretching(h.shape[2], 2 * h.shape[2], kind)))
            h = s @ h
        else:
            name = step[1]
            y = _convolve(h, found[f"{name}.w"], found[f"{name}.b"])
            mean, var = (y.mean(axis=(0, 1, 2)), y.var(axis=(0, 1, 2))) if train else (found[f"{name}.mean"], found[f"{name}.var"])
            scale = 1 / np.sqrt(var + kind.type(EPS))
            z = (y - mean) * scale
            v = z * found[f"{name}.gain"] + found[f"{name}.shift"]
            tape.append((step, h, z, scale, v, mean, var))
            h = np.where(v > 0, v, np.expm1(np.minimum(v, 0)))
    if h.shape[2] != t:
        tape.append((("stretch",), s := _stretching(h.shape[2], t, kind)))
        h = s @ h
    tape.append((("head",), h.shape[1], g := h.mean(axis=1)))
    return (g @ found["head.w"][:, :, 0, 0].T + found["head.b"]).transpose(0, 2, 1), tape


def back(dwave: np.ndarray, tape: list, found: Weights) -> Weights:
    """Gradients of all trainable weights, of a run in training, from that of its waveforms."""
    grads: Weights = {}
    dy = dwave.transpose(0, 2, 1)
    _, m, g = tape[-1]
    grads["head.w"] = np.einsum("bto,btc->oc", dy, g)[:, :, None, None]
    grads["head.b"] = dy.sum(axis=(0, 1))
    dh = np.repeat((dy @ found["head.w"][:, :, 0, 0])[:, None] / dy.dtype.type(m), m, axis=1)
    for step, *held in reversed(tape[:-1]):
        if step[0] == "pool":
            dh = _pool_back(dh, held[0], *step[1:])
        elif step[0] == "stretch":
            dh = held[0].T @ dh
        else:
            name, (h, z, scale, v, _, _) = step[1], held
            dv = dh * np.where(v > 0, dh.dtype.type(1), np.exp(np.minimum(v, 0)))
            grads[f"{name}.gain"], grads[f"{name}.shift"] = (dv * z).sum(axis=(0, 1, 2)), dv.sum(axis=(0, 1, 2))
            dz = dv * found[f"{name}.gain"]
            dconv = scale * (dz - dz.mean(axis=(0, 1, 2)) - z * (dz * z).mean(axis=(0, 1, 2)))
            dh, grads[f"{name}.w"], grads[f"{name}.b"] = _convolve_back(dconv, h, found[f"{name}.w"])
    return grads


def batch_statistics(tape: list) -> Weights:
    """Mean and unbiased variance of each normalisation's input in a run in training."""
    out: Weights = {}
    for step, *held in tape:
        if step[0] == "block":
            n = held[1][..., 0].size
            out |= {f"{step[1]}.mean": held[4], f"{step[1]}.var": held[5] * n / max(1, n - 1)}
    return out


def moved(found: Weights, statistics: Weights) -> Weights:
    """Weights whose running statistics have taken in a batch's."""
    return found | {k: ((1 - MOMENTUM) * found[k] + MOMENTUM * v).astype(found[k].dtype) for k, v in statistics.items()}


def forward(x: np.ndarray, found: Weights) -> np.ndarray:
    """Waveform of length T of one map (M, T), M >= 16, with running statistics; (outputs, T) of a network with several."""
    wave = run(x[None], found)[0][0]
    return wave[0] if len(wave) == 1 else wave
