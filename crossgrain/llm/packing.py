"""Sequence packing: shortest pack first over the histogram of lengths.

Documents are tokenized once, where they lie, into a table in the shared folder.
A document is cut at every ``size`` tokens; the rest, its tail, is of one of
``size - 1`` lengths. The histogram of tail lengths, fixed in size whatever the
corpus, is all the driver sees. There lengths are placed longest first, each
into the shortest pack that exists, and packs are held as patterns with counts,
so that one step places up to all tails of a length. Where the packs so made
leave more than ``slack`` of padding, the emptiest packs are undone and their
tails cut to fill the gaps of the others, again by pattern counts.

A tail finds its pack by its rank among the tails of its length. The task that
tokenized it numbered it within the task, and sums over tasks turn that into a
rank, so nothing is sorted, and no length is gathered in one place, however
common. Patterns are looked up by rank in a table bounded by the histogram.

Defined cases: a null text is empty and gives the end id alone; equal rows are
packed each; an empty table gives no piece.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import keyed, read_table, written

SIZE = 2048
END = 1


def default_tokenizer() -> str:
    """The path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A run of white space from this length on is left to ``tokenizers``: ``tiktoken`` fails on a million characters of it.
LONG_SPACE = 100_000
_SPACE = re.compile(r"\s+")


def encoder(path: str):
    """text -> ids, as ``tokenizers`` gives them for the file with ``add_special_tokens=False``.

    A ``.json`` file with a ``.tiktoken`` file of the same vocabulary beside it is
    encoded by ``tiktoken``, which gives the same ids several times faster. The
    file's added tokens are found in texts too, as ``tokenizers`` does.
    """
    from pathlib import Path

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    exact = lambda text: whole.encode(text, add_special_tokens=False).ids
    ranks = Path(path).with_suffix(".tiktoken")
    added = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    if not ranks.exists() or any(t.lstrip or t.rstrip or t.single_word for t in whole.get_added_tokens_decoder().values()):
        return exact
    import public_tokenizers
    import tiktoken

    with ranks.open("rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in _SPACE.finditer(text)):
            return exact(text)
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # a panic of tiktoken is no Exception
            if type(e).__name__ != "PanicException" and not isinstance(e, Exception):
                raise
            return exact(text)

    return encode


@dataclass
class Shape:
    """``count`` tails of ``length``, cut at the same places."""

    length: int
    cuts: tuple[int, ...]  # ends of the pieces
    count: int


@dataclass
class Pattern:
    """``count`` packs that hold the same pieces; a piece is (shape, number of the piece)."""

    pieces: list[tuple[Shape, int]]
    used: int
    count: int


@dataclass
class Plan:
    """Where the tail of a length and rank goes."""

    size: int
    sequences: int = 0
    tails: dict[int, tuple[list[int], list[list[tuple[int, int, list[int], list[tuple[int, int]]]]]]] = field(default_factory=dict)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of one tail."""
        firsts, shapes = self.tails[length]
        at = bisect_right(firsts, rank) - 1
        rank -= firsts[at]
        out = []
        for start, end, ranks, places in shapes[at]:
            k = bisect_right(ranks, rank) - 1
            sequence, offset = places[k]
            out.append((start, end - start, sequence + rank - ranks[k], offset))
        return out


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Packs for ``count`` tails of each length, none cut."""
    order = 0
    packs: list[tuple[int, int, Pattern]] = []  # by used: the shortest first
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        shape = Shape(length, (length,), left)
        filled = []
        while left and packs and packs[0][0] + length <= size:
            _, _, pattern = heapq.heappop(packs)
            n = min(left, pattern.count)
            if pattern.count > n:
                heapq.heappush(packs, (pattern.used, order := order + 1, Pattern(pattern.pieces, pattern.used, pattern.count - n)))
            filled.append(Pattern([*pattern.pieces, (shape, 0)], pattern.used + length, n))
            left -= n
            if left and packs and packs[0][0] + length > size or not packs:  # packs just filled may take another
                for p in filled:
                    heapq.heappush(packs, (p.used, order := order + 1, p))
                filled = []
        if each := size // length if left else 0:  # new packs: the shortest pack that fits is then the one just opened
            filled += [Pattern([(shape, 0)] * each, length * each, left // each), Pattern([(shape, 0)] * (left % each), length * (left % each), 1)]
        for p in filled:
            if p.used and p.count:
                heapq.heappush(packs, (p.used, order := order + 1, p))
    return [p for _, _, p in packs]


def fill_gaps(patterns: list[Pattern], size: int, slack: float) -> list[Pattern]:
    """Undoes the emptiest packs and cuts their tails into the gaps of others, until padding is within ``slack``."""
    total = sum(p.used * p.count for p in patterns)
    padding = sum((size - p.used) * p.count for p in patterns)
    done: list[Pattern] = [p for p in patterns if p.used == size]
    order = 0
    heap: list[tuple[int, int, Pattern]] = []  # packs of whole tails
    holders: list[tuple[int, int, Pattern]] = []  # packs with a piece of a cut tail, which is cut at one time only

    def put(p: Pattern) -> None:
        nonlocal order
        if p.count:
            heapq.heappush(holders if any(len(s.cuts) > 1 for s, _ in p.pieces) else heap, (p.used, order := order + 1, p))

    for p in patterns:
        if p.used < size:
            put(p)
    while heap and padding > slack * total:
        donor = heapq.heappop(heap)[2]
        n = max(1, donor.count // 8)
        put(Pattern(donor.pieces, donor.used, donor.count - n))
        takers, room = [], 0
        while (holders or heap) and room < donor.used:
            taker = heapq.heappop(holders or heap)[2]
            put(Pattern(taker.pieces, taker.used, max(0, taker.count - n)))
            takers.append(Pattern(taker.pieces, taker.used, min(taker.count, n)))
            room += size - taker.used
        if room < donor.used:
            done.append(Pattern(donor.pieces, donor.used, n))
            for t in takers:
                put(t)
            continue
        n_now = min(n, *(t.count for t in takers))
        put(Pattern(donor.pieces, donor.used, n - n_now))
        rest = [(shape.length, shape) for shape, _ in donor.pieces]
        gaps = [size - t.used for t in takers]
        added: list[list[tuple[Shape, int]]] = [[] for _ in takers]
        k = 0
        for length, old in rest:
            cuts, at, where = [], 0, []
            while at < length:
                step = min(length - at, gaps[k])
                at += step
                gaps[k] -= step
                cuts.append(at)
                where.append(k)
                k += gaps[k] == 0
            shape = Shape(length, tuple(cuts), n_now)
            old.count -= n_now
            for j, w in enumerate(where):
                added[w].append((shape, j))
        for taker, new, gap in zip(takers, added, gaps):
            filled = Pattern([*taker.pieces, *new], size - gap, n_now)
            put(Pattern(taker.pieces, taker.used, taker.count - n_now))
            if gap:
                put(filled)
            else:
                done.append(filled)
        padding -= size * n_now
    return done + [p for _, _, p in heap + holders]


def plan(histogram: dict[int, int], size: int, slack: float = 0.002) -> Plan:
    """The packs of tails, numbered from 0, and for each length which ranks go where."""
    patterns = [p for p in fill_gaps(shortest_pack_first(histogram, size), size, slack) if p.count]
    out = Plan(size)
    places: dict[int, tuple[Shape, list[tuple[list[int], list[tuple[int, int]], list[int]]]]] = {}
    for p in patterns:
        offset = 0
        for shape, j in p.pieces:
            _, own = places.setdefault(id(shape), (shape, [([], [], [0]) for _ in shape.cuts]))
            ranks, where, taken = own[j]
            ranks.append(taken[0])
            where.append((out.sequences, offset))
            taken[0] += p.count
            offset += shape.cuts[j] - (shape.cuts[j - 1] if j else 0)
        out.sequences += p.count
    by_length = defaultdict(list)
    for shape, own in places.values():
        by_length[shape.length].append((shape, own))
    for length, shapes in by_length.items():
        firsts, found, rank = [], [], 0
        for shape, own in shapes:
            if any(taken[0] != shape.count for _, _, taken in own):
                raise ValueError("a shape's pieces are not all placed")
            firsts.append(rank)
            rank += shape.count
            found.append([(a, b, ranks, where) for (a, b), (ranks, where, _) in zip(pairwise((0, *shape.cuts)), own)])
        out.tails[length] = (firsts, found)
    return out


def tokenized(docs: DataFrame, *, id_col: str | Column = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, ids, n, part, cls, k, full, k_full), written: ids as 32-bit numbers less their empty bytes.

    ``part`` is the task, ``cls`` the tail's length, ``k`` the tail's number among
    the task's tails of that length, ``full`` the whole sequences before the tail
    and ``k_full`` the task's whole sequences so far.
    """
    path = tokenizer or default_tokenizer()
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    rows = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen, k_full = defaultdict(int), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                ids, rest = [], []
                for text in own.column(1).to_pylist():
                    row = np.array([*encode(text or ""), end], np.uint32)
                    n, full, cls = len(row), len(row) // size, len(row) % size
                    ids.append((row.astype(np.uint16) if row.max() < 1 << 16 else row).tobytes())
                    rest.append((n, part, cls, seen[cls], full, k_full))
                    seen[cls] += 1
                    k_full += full
                cols = [pa.array([r[i] for r in rest], pa.int64()) for i in range(6)]
                yield pa.record_batch([own.column(0), pa.array(ids, pa.binary()), *cols], names=["doc_id", "ids", "n", "part", "cls", "k", "full", "k_full"])

    kind = rows.schema[0].dataType
    return written(rows.mapInArrow(run, keyed("doc_id", kind, "ids binary, n long, part long, cls long, k long, full long, k_full long")), "tokens")


def pack(docs: DataFrame, *, id_col: str | Column = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int = END, slack: float = 0.002) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""
    tokens = tokenized(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, size=size, end=end)
    counts = written(tokens.groupBy("part", "cls").agg(F.count("*").alias("tails"), F.sum("full").alias("full")), "counts")
    histogram = {r.cls: r.n for r in counts.groupBy("cls").agg(F.sum("tails").alias("n")).collect() if r.cls}
    packs = plan(histogram, size, slack)
    before = lambda *keys: Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tails = counts.select("part", "cls", F.coalesce(F.sum("tails").over(before("cls")), F.lit(0)).alias("tails_before"))
    wholes = counts.groupBy("part").agg(F.sum("full").alias("full"))
    wholes = wholes.select("part", F.coalesce(F.sum("full").over(before()), F.lit(0)).alias("full_before"))
    ranked = tokens.join(tails.join(wholes, "part").hint("shuffle_hash"), ["part", "cls"])
    rows = ranked.select("doc_id", "ids", "n", "cls", (F.col("k") + F.col("tails_before")).alias("k"), (F.col("k_full") + F.col("full_before")).alias("k_full"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = batch.slice(at, 1000)
                n, cls, k, k_full = (c.to_pylist() for c in own.columns[2:])
                place, rows, ids = [], [], []
                for i, data in enumerate(own.column(1).to_pylist()):
                    values = np.frombuffer(data, np.uint16 if len(data) == 2 * n[i] else np.uint32)
                    full = n[i] // size
                    pieces = [(j * size, size, packs.sequences + k_full[i] + j, 0) for j in range(full)]
                    if cls[i]:
                        pieces += [(full * size + a, *rest) for a, *rest in packs.pieces(cls[i], k[i])]
                    for start, length, sequence, offset in pieces:
                        place.append(i)
                        rows.append((start, length, n[i], sequence, offset))
                        ids.append(values[start : start + length])
                cols = [pa.array([r[j] for r in rows], pa.int64()) for j in range(5)]
                ends = np.cumsum([0, *(len(x) for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)))
                yield pa.record_batch([own.column(0).take(pa.array(place, pa.int64())), *cols[:2], lists, *cols[2:]], names=names)

    kind = rows.schema[0].dataType
    return rows.mapInArrow(run, keyed("doc_id", kind, "start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = pack(read_table(spark, sf_dir, "documents"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in pairwise(ends.tolist())]
            yield pa.record_batch([*batch.columns[:3], pa.array(sums, pa.int64()), *batch.columns[4:]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = pieces.schema[0].dataType
    return pieces.mapInArrow(run, keyed("doc_id", kind, "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
