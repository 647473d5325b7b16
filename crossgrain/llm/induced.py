"""External induced suffix sorting of one shard, with common-prefix values.

Suffixes are S- or L-type; the leftmost S-type ones (S*) seed the order. A queue
for each symbol takes suffixes in rising order, so a queue is sorted as it is
filled: popping the smallest suffix pushes its left neighbour, if that is L-type,
to the queue of the neighbour's symbol, and a second sweep from the top does the
same for S-types. That is the monotone priority queue of external induced sorting.
Queues keep a bounded part in memory and the rest in unnamed temporary files of
the task, which go with it, and are written and read from end to end.

The S* suffixes are ordered by a first induction, which sorts the S* substrings;
equal ones get equal names, and the string of names is sorted in turn: its ranks
double the span they compare until they differ or span ``cap`` symbols, which is
all a search for repeats of ``cap`` symbols needs. The second induction then
carries the order to all suffixes. ``common_prefix`` gives exact values, up to
``cap``, for neighbours in the order.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Suffixes that all queues of a sweep hold in memory; 4 bytes each.
IN_MEMORY = 32 << 20


class Queue:
    """Numbers first in, first out; spills to a temporary file."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = self.held = 0
        self.file = None

    def push(self, x: np.ndarray) -> None:
        self.parts.append(x)
        self.size += len(x)
        self.held += len(x)

    def spill(self) -> None:
        if self.held:
            self.file = self.file or tempfile.TemporaryFile()
            for x in self.parts:
                self.file.write(x.tobytes())
            self.parts, self.held = [], 0

    def take(self) -> np.ndarray:
        """Everything in the queue, which is then empty."""
        out = list(self.parts)
        if self.file:
            self.file.seek(0)
            out.insert(0, np.frombuffer(self.file.read(), np.int32))
            self.file.close()
            self.file = None
        self.parts, self.size, self.held = [], 0, 0
        return np.concatenate(out) if out else np.empty(0, np.int32)


class Sweep:
    """The queues of one sweep."""

    def __init__(self, symbols: int, memory: int) -> None:
        self.queues = [Queue() for _ in range(symbols)]
        self.memory, self.held = memory, 0

    def push(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        """Adds suffixes to their symbols' queues, in the order given."""
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[order], suffixes[order]
        edges = np.nonzero(symbols[1:] != symbols[:-1])[0] + 1
        for part, at in zip(np.split(suffixes, edges), [0, *edges.tolist()]):
            self.queues[symbols[at]].push(part)
        self.held += len(suffixes)
        if self.held > self.memory:
            for q in self.queues:
                q.spill()
            self.held = 0


def types_of(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the next. The last, the sentinel, is S-type."""
    rising = np.ones(len(text), np.int8)
    rising[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])  # 1: S, -1: L, 0: as the next
    settled = np.nonzero(rising)[0]
    return rising[settled[np.searchsorted(settled, np.arange(len(text)))]] > 0


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int, memory: int = IN_MEMORY) -> np.ndarray:
    """All suffixes in order, given the S* suffixes ``seeds`` in order."""
    up, down = Sweep(symbols, memory), Sweep(symbols, memory)
    stars = Sweep(symbols, memory)
    stars.push(text[seeds], seeds)
    large: list[Queue] = []

    def left_of(x: np.ndarray, want_small: bool) -> np.ndarray:
        left = x[x > 0] - 1
        return left[small[left] == want_small]

    for c in range(symbols):
        kept = Queue()
        now = up.queues[c].take()
        while len(now):
            kept.push(now)
            left = left_of(now, False)
            same = text[left] == c
            up.push(text[left[~same]], left[~same])
            now = left[same]
        left = left_of(stars.queues[c].take(), False)
        up.push(text[left], left)
        if kept.size > memory // 64:
            kept.spill()
        large.append(kept)
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        now = down.queues[c].take() if c else np.array([len(text) - 1], np.int32)
        rising: list[np.ndarray] = []
        while len(now):
            rising.append(now)
            left = left_of(now, True)
            same = text[left] == c
            down.push(text[left[~same]], left[~same])
            now = left[same]
        own = large[c].take()
        left = left_of(own[::-1], True)
        down.push(text[left], left)
        out += [x[::-1] for x in rising] + [own]  # descending S-types, then the L-types below them
    return np.concatenate(out[::-1])


def words_at(text: np.ndarray) -> np.ndarray:
    """Four neighbouring 16-bit symbols at every place as one number, the first highest; zeros follow the text."""
    line = np.concatenate([text.astype(np.uint64), np.zeros(3, np.uint64)])
    n = len(text)
    return line[:n] << np.uint64(48) | line[1 : n + 1] << np.uint64(32) | line[2 : n + 2] << np.uint64(16) | line[3 : n + 3]


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """The length of the common prefix of suffixes ``a`` and ``b``, at most ``cap``."""
    out = np.full(len(a), cap, np.int32)
    active = np.arange(len(a))
    last = len(words)
    for at in range(0, cap, 4):
        x, y = a[active].astype(np.int64) + at, b[active].astype(np.int64) + at
        differ = np.where(x < last, words[np.minimum(x, last - 1)], 0) ^ np.where(y < last, words[np.minimum(y, last - 1)], 0)
        ends = (x >= last) | (y >= last)
        stop = (differ != 0) | ends
        d = differ[stop]
        same = np.where(d >> np.uint64(48) != 0, 0, np.where(d >> np.uint64(32) != 0, 1, np.where(d >> np.uint64(16) != 0, 2, np.where(d != 0, 3, 0))))
        out[active[stop]] = np.minimum(cap, at + same)
        active = active[~stop]
        if not len(active):
            break
    return out


def suffix_array(text: np.ndarray, symbols: int, cap: int, memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, words of the text); suffixes alike in ``cap`` symbols may stand in any order.

    ``text`` holds 16-bit symbols below ``symbols``; the last is 0 and the only 0.
    """
    words = words_at(text)
    small = types_of(text)
    stars = (np.nonzero(small[1:] & ~small[:-1])[0] + 1).astype(np.int32)
    if len(stars) <= 1:
        return induce(text, small, stars if len(stars) else np.array([len(text) - 1], np.int32), symbols, memory), words
    rough = induce(text, small, stars, symbols, memory)
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    ordered = rough[is_star[rough]]
    place = np.full(len(text), -1, np.int32)
    place[stars] = np.arange(len(stars), dtype=np.int32)
    at = place[ordered]
    length = np.append(np.diff(stars), 0)[at] + 1  # to the next S*, both included; the sentinel is itself
    a, b = ordered[:-1], ordered[1:]
    same = (length[:-1] == length[1:]) & (common_prefix(words, a, b, max(4, min(cap, int(length.max())))) >= np.minimum(length[:-1], cap))
    rank = np.empty(len(stars), np.int64)
    rank[at] = np.concatenate([[0], np.cumsum(~same)])
    span, distinct = 1, int(rank.max()) + 1
    while distinct < len(rank) and span < cap:
        following = np.concatenate([rank[span:] + 1, np.zeros(min(span, len(rank)), np.int64)])[: len(rank)]
        keys, rank = np.unique(rank * (distinct + 1) + following, return_inverse=True)
        distinct, span = len(keys), span * 2
    return induce(text, small, stars[np.argsort(rank, kind="stable")], symbols, memory), words
