"""Best-fit packing: a configuration linear program over the histogram of lengths.

A document longer than ``size`` is cut into pieces of ``size`` tokens, of which
the first may be shorter; that one, the head, is all that has to be placed. The
histogram of head lengths, fixed in size whatever the corpus, is what the
driver sees. A configuration is a multiset of lengths that fits one sequence,
and the program asks for the fewest configurations that cover the histogram.

Multiplicative weights solve it. A length's price starts at its number of tokens
and falls by a factor as its heads are covered, so that what lags behind is worth
more. A knapsack dynamic program finds the most that one sequence can be worth
at the current prices; the configurations it finds within ``epsilon`` of that
are taken together, each for as many sequences as cover at most a ``step``-th of
any of its lengths. Each round's prices also bound the optimum from below.

Rounding takes the whole part of each configuration's count. What is left over
is a smaller histogram, which is solved again while it holds more than a few
heads a length; these last ones go longest first into the fullest sequence that
has room.

A head finds its place by its rank among the heads of its length; the task that
tokenized it numbered it, and sums over tasks make that a rank.

Defined cases: a null text is empty and gives the end id alone; equal rows are
packed each; an empty table gives no piece; null ids are carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import keyed, read_table, written
from crossgrain.llm.packing import SIZE, tokenized

END = 0
#: A configuration: (length, copies), longest first.
Configuration = tuple[tuple[int, int], ...]


def knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> np.ndarray:
    """The most that any multiset of lengths is worth, for each room from 0 to ``size``."""
    worth, best = np.full(size + 1, -np.inf), np.zeros(size + 1)
    worth[lengths] = prices
    for room in range(int(lengths[0]), size + 1):
        best[room] = max(best[room - 1], (worth[1 : room + 1] + best[room - 1 :: -1][:room]).max())
    return best


def walk_back(first: int, lengths: np.ndarray, prices: np.ndarray, best: np.ndarray, left: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """A configuration from ``first`` on: what the knapsack would take at each step, among what is left."""
    taken, room, worth, own = {first: 1}, size - int(lengths[first]), float(prices[first]), left.copy()
    own[first] -= 1
    while n := bisect_right(lengths, room):
        gains = np.where(own[:n] >= 1, prices[:n] + best[room - lengths[:n]], -1.0)
        at = int(gains.argmax())
        if gains[at] < 0:
            break
        copies = 1
        while copies < own[at] - 1e-9 and lengths[at] * (copies + 1) <= room and best[room] - best[room - lengths[at] * (copies + 1)] <= prices[at] * (copies + 1) * (1 + 1e-9):
            copies += 1
        copies = min(copies, int(own[at]))
        own[at] -= copies
        taken[at] = taken.get(at, 0) + copies
        room -= copies * int(lengths[at])
        worth += copies * float(prices[at])
    return worth, taken


def linear_program(histogram: dict[int, int], size: int, *, epsilon: float = 0.001, step: int = 8, rate: float = 0.1, favour: float = 0.1, most: float = 0.003, rest: float = 0.02) -> tuple[dict[Configuration, float], float]:
    """Counts of configurations that cover all but a ``rest`` of the tokens at most, and a lower bound of the optimum.

    The bound is the prices' own: no sequence is worth more than the knapsack's optimum, so at least the worth of all heads
    divided by it is needed. A round takes configurations within a slack of its optimum, and no more than a ``step``-th of a
    length's heads (one head at least). The slack is ``epsilon``, and up to ``most`` after rounds that covered little (more only
    where nothing was covered). Prices begin with ``favour`` for the long, which are the harder to place.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[n] for n in lengths], float)
    left, counts, bound, slack = need.copy(), {}, float(need @ lengths) / size, epsilon  # the first bound: a token is worth one
    while left @ lengths > rest * (need @ lengths):
        open_ = np.flatnonzero(left >= 1)
        if not open_.size:
            break
        own = lengths[open_]
        prices = own * (1 + favour * own / size) * np.exp(rate * (left[open_] / need[open_] - 1))
        best = knapsack(own, prices, size)
        bound = max(bound, float(prices @ need[open_]) / float(best[size]))
        budget = np.minimum(left[open_], np.maximum(need[open_] / step, 1.0))
        firsts = prices + best[size - own]
        before, least, misses = left @ lengths, best[size], 0
        for first in np.argsort(-firsts, kind="stable"):
            while budget[first] >= 1 and misses < 50:
                worth, config = walk_back(int(first), own, prices, best, budget, size)
                if worth < (1 - slack) * least:
                    misses += 1
                    break
                misses = 0
                times = min(budget[i] / a for i, a in config.items())
                for i, a in config.items():
                    budget[i] -= a * times
                    left[open_[i]] -= a * times
                key = tuple(sorted(((int(own[i]), a) for i, a in config.items()), reverse=True))
                counts[key] = counts.get(key, 0.0) + times
        gained = (before - left @ lengths) / before
        slack = slack * 2 if not gained else max(epsilon, slack / 2) if gained > 1 / step else min(max(most, slack), slack * 2) if gained < 0.5 / step else slack
    return counts, bound


def fullest_first(histogram: dict[int, int], size: int) -> Counter[Configuration]:
    """The last heads, longest first, each into the fullest sequence that has room."""
    used: list[tuple[int, int]] = []  # (used, number), sorted
    held: list[list[int]] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect_right(used, (size - length, len(held))) - 1
            total, number = used.pop(at) if at >= 0 else (0, len(held))
            if number == len(held):
                held.append([])
            held[number].append(length)
            used.insert(bisect_left(used, (total + length, number)), (total + length, number))
    return Counter(tuple(sorted(Counter(h).items(), reverse=True)) for h in held)


def solve(histogram: dict[int, int], size: int, *, few: int = 16, **options: float) -> tuple[Counter[Configuration], float]:
    """Whole counts of configurations that hold each head once, and a lower bound of their number."""
    left = Counter({n: c for n, c in histogram.items() if c})
    chosen: Counter[Configuration] = Counter()
    bound = 0.0
    while left and (not chosen or sum(left.values()) > few * len(left)):
        fractional, lower = linear_program(left, size, **options)
        bound = bound or lower
        taken = 0
        for config, times in sorted(fractional.items(), key=lambda x: (-x[1], x[0])):
            whole = min(int(times + 1e-6), *(left[n] // a for n, a in config))
            if whole > 0:
                chosen[config] += whole
                taken += whole
                left.subtract({n: a * whole for n, a in config})
        left = +left
        if not taken:
            break
    return chosen + fullest_first(left, size), bound


@dataclass
class Places:
    """Where the head of a length and rank goes: runs of ranks, each in the same place of consecutive sequences."""

    sequences: int = 0
    runs: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = field(default_factory=dict)  # first ranks; (sequence, offset, copies)

    def of(self, length: int, rank: int) -> tuple[int, int]:
        """(sequence, offset)"""
        firsts, places = self.runs[length]
        at = bisect_right(firsts, rank) - 1
        sequence, offset, copies = places[at]
        along, copy = divmod(rank - firsts[at], copies)
        return sequence + along, offset + copy * length


def places(chosen: Counter[Configuration]) -> Places:
    """Numbers the sequences from 0 and deals the ranks of each length to them."""
    out, seen = Places(), Counter()
    for config, times in chosen.items():
        offset = 0
        for length, copies in config:
            firsts, where = out.runs.setdefault(length, ([], []))
            firsts.append(seen[length])
            where.append((out.sequences, offset, copies))
            seen[length] += copies * times
            offset += copies * length
        out.sequences += times
    return out


def best_fit_pack(docs: DataFrame, *, id_col: str | Column = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids, sequence_id, offset)."""
    tokens = tokenized(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, size=size, end=end)
    counts = written(tokens.groupBy("part", "cls").agg(F.count("*").alias("heads"), F.sum("full").alias("full")), "head-counts")
    histogram = {r.cls: r.n for r in counts.groupBy("cls").agg(F.sum("heads").alias("n")).collect() if r.cls}
    plan = places(solve(histogram, size)[0])
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select("part", "cls", F.coalesce(F.sum("heads").over(earlier("cls")), F.lit(0)).alias("heads_before"))
    wholes = counts.groupBy("part").agg(F.sum("full").alias("full"))
    wholes = wholes.select("part", F.coalesce(F.sum("full").over(earlier()), F.lit(0)).alias("full_before"))
    ranked = tokens.join(heads.join(wholes, "part").hint("shuffle_hash"), ["part", "cls"])
    rows = ranked.select("doc_id", "ids", "n", "cls", (F.col("k") + F.col("heads_before")).alias("k"), (F.col("k_full") + F.col("full_before")).alias("k_full"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = batch.slice(at, 1000)
                n, cls, k, k_full = (c.to_pylist() for c in own.columns[2:])
                source, rows, ids = [], [], []
                for i, data in enumerate(own.column(1).to_pylist()):
                    values = np.frombuffer(data, np.uint16 if len(data) == 2 * n[i] else np.uint32)
                    pieces = [(0, cls[i], *plan.of(cls[i], k[i]))] if cls[i] else []
                    pieces += [(cls[i] + j * size, size, plan.sequences + k_full[i] + j, 0) for j in range(n[i] // size)]
                    for piece, (start, length, sequence, offset) in enumerate(pieces):
                        source.append(i)
                        rows.append((piece, start, length, sequence, offset))
                        ids.append(values[start : start + length])
                cols = [pa.array([r[j] for r in rows], pa.int32() if j == 0 else pa.int64()) for j in range(5)]
                ends = np.cumsum([0, *(len(x) for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)))
                yield pa.record_batch([own.column(0).take(pa.array(source, pa.int64())), *cols[:3], lists, *cols[3:]], names=names)

    kind = rows.schema[0].dataType
    return rows.mapInArrow(run, keyed("doc_id", kind, "piece int, start long, length long, ids array<int>, sequence_id long, offset long"))


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = best_fit_pack(read_table(spark, sf_dir, "documents"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in pairwise(ends.tolist())]
            yield pa.record_batch([*batch.columns[:4], pa.array(sums, pa.int64()), *batch.columns[5:]], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema[0].dataType
    return pieces.mapInArrow(run, keyed("doc_id", kind, "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
