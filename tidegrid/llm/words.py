"""Words of whole texts as byte ranges of one array."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def parted_by(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes part words; 0x0A and 0x20 have to be among them."""
    found = np.zeros(256, bool)
    for first, last in ranges:
        found[first : last + 1] = True
    return found


def compact(texts: list[str | None], parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first and end of each word in them, first word of each text and the end).

    A-Z are lower-cased and exactly one space stands after each word, so that a run of words of a text is one range.
    """
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    space = parting[data]
    after = np.zeros(len(data), bool)
    after[1:] = space[1:] & ~space[:-1]
    bounds = np.searchsorted(np.flatnonzero(after), np.cumsum([len(t) + 1 for t in raw]))
    data[space] = 0x20
    data = data[~space | after]
    end = np.flatnonzero(data == 0x20)
    first = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    return data, first, end, np.concatenate([[0], bounds])


def runs(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of n consecutive words that lie in one text: number of each run's first word, and runs of each text."""
    words = np.diff(bounds)
    each = np.maximum(words - n + 1, 0)
    start = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(each)[:-1]]), each)
    return start + np.arange(each.sum()), each
