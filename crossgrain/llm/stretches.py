"""Cuts texts into stretches that bring equal ``length``-byte strings together.

Every window of ``length`` bytes has an anchor: of the ``seed_length``-byte seeds
in it the one with the smallest hash, the leftmost of equals. Equal windows have
equal anchors at the same place. A stretch is a maximal run of windows of one text
with one anchor, so windows that are equal are in stretches whose anchors are
equal, wherever they are in the corpus.
"""

from __future__ import annotations

import numpy as np

#: Bits of a hash's place that order seeds within a segment.
PLACE = 20
#: Segments of a long text overlap, so that every window lies in one.
SEGMENT = 1 << PLACE
_MIX = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def seed_hashes(data: np.ndarray, seed_length: int) -> np.ndarray:
    """A mixed polynomial hash of the bytes of each seed; ``seed_length`` is a power of two."""
    h, base, span = _MIX[data], _BASE, 1
    with np.errstate(over="ignore"):
        while span < seed_length:
            h = h[:-span] * np.uint64(base) + h[span:]
            base, span = base * base % (1 << 64), span * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def stretches(data: np.ndarray, length: int, seed_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window's start, number of windows) of a text's stretches, in order."""
    out: list[tuple[np.ndarray, ...]] = []
    step = SEGMENT - length + 1
    for base in range(0, max(0, len(data) - length + 1), step):
        part = data[base : base + SEGMENT]
        h = seed_hashes(part, seed_length)
        mask = np.uint64(SEGMENT - 1)
        least = sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - seed_length + 1)
        at = (least & mask).astype(np.int64)
        starts = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
        out.append((h[at[starts]], starts + base, np.diff(np.append(starts, len(at)))))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))
