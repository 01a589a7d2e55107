"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import mix64
from .suffix_dedup import Rolling

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in one array; first word of each text and the end.

    A-Z are lower-cased; words are parted by spaces and the control characters 9 to 13.
    """
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in raw])
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = mix64(Rolling(data).of(first, end) + (end - first).astype(np.uint64) * _ODD[0])
    return hashes, np.searchsorted(first, np.concatenate([[0], ends]))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``words`` words; with fewer words, of the whole sequence; without, none."""
    hashes, bounds = word_hashes(texts)
    grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        grams += mix64(hashes[k : k + len(grams)] * _ODD[k % 7] + np.uint64(k))
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= words:
            out.append(np.unique(grams[a : z - words + 1]))
        elif z > a:
            whole = np.array([z - a], np.uint64)
            for k in range(a, z):
                whole = mix64(whole * _ODD[1] + hashes[k : k + 1] * _ODD[2 + (k - a) % 5])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_digest(members: np.ndarray) -> int:
    """One signed 64-bit digest of a set."""
    total = mix64(members ^ _ODD[3]).sum(dtype=np.uint64, keepdims=True) + np.array([len(members)], np.uint64) * _ODD[4]
    return int(mix64(total).view(np.int64)[0])
