"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions, each with its own tree of contexts:
the last 0 to ``depth`` bytes. Every node holds a Krichevsky-Trofimov estimate of
its decision and the tree mixes, at each node, that estimate with the product of
its children, half and half, which weighs all depths against each other. A text
starts after ``depth`` start symbols and ends with an end symbol, two byte values
that UTF-8 never uses. After training the tree is fixed, and a byte's probability
depends on the ``depth`` bytes before it alone; so the model is a table with one
row for each string of ``depth + 1`` bytes seen anywhere in the corpus.

Nothing that grows with the corpus is sent to every task. Documents belong to
chunks, ranges of rows of a file. A chunk's scan counts its distinct
words and byte strings; sums over chunks make the corpus counts. The tree is
computed where the strings of one two-byte context are, level by level from the
longest contexts up; only the nodes of the last byte and the root, at most 65,535
and 255, are added up for all. The rows a chunk asked for go back to it, and meet
its documents, which are dealt by chunk.

Defined cases: null is the empty text: one end token and one end symbol; equal
rows each get their row; with no training rows every estimate is uniform; a null
id counts as empty text in the choice of held-out rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.common import keyed, read_table, remainder_is, spread, written

START, END_OF_TEXT = 0xFE, 0xFF
#: The end token, which is no word: words hold no line feed.
END_TOKEN = b"\n"
#: Bytes of text turned into strings of depth + 1 bytes at once.
BLOCK = 4 << 20
#: Bytes of text in a chunk, on average.
CHUNK = 32 << 20


def tokens_of(data: bytes) -> list[bytes]:
    """Lower-cased words and the end token."""
    return [*data.lower().split(), END_TOKEN]


def symbols(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For all texts in turn, the string that ends at each symbol, as a number whose low byte is the
    symbol and whose next bytes are its context, nearest first; and how many symbols each text has."""
    sizes = np.array([len(t) + 1 for t in texts])
    line = np.frombuffer(b"".join(p for t in texts for p in (bytes([START]) * depth, t, bytes([END_OF_TEXT]))), np.uint8)
    out = line.astype(np.uint64)
    for i in range(1, depth + 1):
        out[i:] |= line[:-i].astype(np.uint64) << np.uint64(8 * i)
    coded = np.ones(len(line), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    for i in range(depth):
        coded[starts + i] = False
    return out[coded], sizes


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about BLOCK bytes."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


# ---- counting ------------------------------------------------------------------------------------


def requests(docs: DataFrame, *, depth: int) -> DataFrame:
    """(chunk, word, gram, n): the distinct words and byte strings of each chunk of ``docs(chunk, learn, data)``.

    ``n`` counts those in rows to learn from; a row is a word or a byte string.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, words, grams = None, (Counter(), set()), []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal words, grams
            learned, other = words
            every = [*learned, *(w for w in other if w not in learned)]
            n = len(every)
            counts = np.zeros(n, np.int64)
            counts[: len(learned)] = list(learned.values())
            keys, sums = added(grams)
            for a in range(0, n, 100_000):
                own = every[a : a + 100_000]
                yield pa.record_batch([pa.array([chunk] * len(own), pa.int64()), pa.array(own, pa.binary()), pa.nulls(len(own), pa.int64()), pa.array(counts[a : a + 100_000])], names=["chunk", "word", "gram", "n"])
            if len(keys):
                yield pa.record_batch([pa.array(np.full(len(keys), chunk, np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(sums)], names=["chunk", "word", "gram", "n"])
            words, grams = (Counter(), set()), []

        for batch in batches:
            chunks, learn, data = (c.to_pylist() for c in batch.columns)
            for a, b in blocks(data):
                while a < b:
                    if chunks[a] != chunk:
                        if chunk is not None:
                            yield from flush()
                        chunk = chunks[a]
                    to = a
                    while to < b and chunks[to] == chunk:
                        to += 1
                    for mode in (True, False):
                        texts = [data[i] for i in range(a, to) if learn[i] == mode]
                        if texts:
                            for t in texts:
                                words[0 if mode else 1].update(tokens_of(t))
                            keys, counts = np.unique(symbols(texts, depth)[0], return_counts=True)
                            grams.append((keys, counts if mode else np.zeros(len(keys), np.int64)))
                    if len(grams) >= 8:
                        grams = [added(grams)]
                    a = to
        if chunk is not None:
            yield from flush()

    return docs.mapInArrow(run, "chunk long, word binary, gram long, n long")


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, np.concatenate([n for _, n in parts]))
    return keys, sums


# ---- the tree ------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 0.5 (Stirling's series, shifted)."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift[small] += np.log(x[small])
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def decisions(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol its eight decisions: the node (1 and the bits so far) and the bit; shape (n, 8)."""
    k = np.arange(8)
    symbol = symbol.astype(np.int64)[:, None]
    return (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1


class Level:
    """The nodes of one depth: context and decision, counts, weighted probability and weight of their own estimate."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> None:
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_kt(zeros, ones)
        if children is None:
            self.log_w, self.share = own, np.ones(len(keys))
        else:
            self.log_w = np.logaddexp(own, children) - math.log(2)
            self.share = np.exp(own - math.log(2) - self.log_w)


def level_of(context: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_w: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """Nodes with the sums of what is below them, and for each row its node's place."""
    keys, place = np.unique(context.astype(np.uint64) << np.uint64(8) | node.astype(np.uint64), return_inverse=True)
    place = place.ravel()
    sums = [np.bincount(place, x, len(keys)) for x in ([zeros, ones] if log_w is None else [zeros, ones, log_w])]
    return Level(keys, sums[0], sums[1], None if log_w is None else sums[2]), place


def context_of(gram: np.ndarray, length: int) -> np.ndarray:
    """The nearest ``length`` bytes of context, the nearest lowest."""
    return (gram >> np.uint64(8)) & np.uint64((1 << 8 * length) - 1)


def subtree(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels ``top`` to ``depth`` for strings that hold every string of their ``top``-byte contexts.

    Also, for each level, the places of the strings' decisions in it, shape (strings, 8).
    """
    node, bit = decisions(gram & np.uint64(0xFF))
    flat = lambda x: np.broadcast_to(x, node.shape).ravel()
    levels: list[Level] = []
    places: list[np.ndarray] = []
    zeros, ones = flat(n[:, None] * (1 - bit)), flat(n[:, None] * bit)
    level, place = level_of(flat(context_of(gram, depth)[:, None]), node.ravel(), zeros, ones, None)
    levels.append(level)
    places.append(place)
    for length in range(depth - 1, top - 1, -1):
        below = levels[0]
        context = (below.keys >> np.uint64(8)) & np.uint64((1 << 8 * length) - 1)
        level, up = level_of(context, below.keys & np.uint64(0xFF), below.zeros, below.ones, below.log_w)
        levels.insert(0, level)
        places.insert(0, up[places[0]])
    return levels, places


def mixed(levels: list[Level], places: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """The probability of each decision under the weighted subtree, from its deepest level up."""
    p = None
    for level, place in zip(reversed(levels), reversed(places)):
        right = np.where(bit == 1, level.ones[place], level.zeros[place])
        own = (right + 0.5) / (level.zeros[place] + level.ones[place] + 1)
        p = own if p is None else level.share[place] * own + (1 - level.share[place]) * p
    return p


def _by_context(grams: DataFrame, top: int) -> DataFrame:
    """(ctx, gram, n) dealt and ordered by the ``top`` nearest bytes."""
    ctx = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))
    return grams.select(ctx.alias("ctx"), "gram", "n").repartition(spread(grams.sparkSession), "ctx").sortWithinPartitions("ctx")


def _whole_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, n) in pieces that end where a context ends."""
    kept: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        now = tuple(c.to_numpy() for c in batch.columns)
        ctx, gram, n = now if kept is None else tuple(np.concatenate(x) for x in zip(kept, now))
        if len(ctx):
            cut = int(np.searchsorted(ctx, ctx[-1]))
            if cut:
                yield gram[:cut].view(np.uint64), n[:cut]
            kept = (ctx[cut:], gram[cut:], n[cut:])
    if kept is not None and len(kept[0]):
        yield kept[1].view(np.uint64), kept[2]


def upper_levels(grams: DataFrame, *, depth: int, top: int) -> list[Level]:
    """The levels above ``top``, from the root down; each has at most 255 nodes for every context of its length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _whole_contexts(batches):
            below = subtree(gram, n, depth, top)[0][0]
            level, place = level_of((below.keys >> np.uint64(8)) & np.uint64((1 << 8 * (top - 1)) - 1), below.keys & np.uint64(0xFF), below.zeros, below.ones, below.log_w)
            log_w = np.bincount(place, below.log_w, len(level.keys))
            yield pa.record_batch([pa.array(level.keys.view(np.int64)), pa.array(level.zeros), pa.array(level.ones), pa.array(log_w)], names=["node", "zeros", "ones", "log_w"])

    sums = _by_context(grams, top).mapInArrow(run, "node long, zeros double, ones double, log_w double").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("log_w"))
    rows = sums.toArrow().to_pydict()
    keys, zeros, ones, log_w = (np.array(rows[c]) for c in ("node", "zeros", "ones", "log_w"))
    out: list[Level] = []
    for length in range(top - 1, -1, -1):
        keys = keys.astype(np.uint64)
        level, _ = level_of((keys >> np.uint64(8)) & np.uint64((1 << 8 * length) - 1), keys & np.uint64(0xFF), zeros, ones, log_w)
        out.insert(0, level)
        keys, zeros, ones, log_w = level.keys, level.zeros, level.ones, level.log_w
    return out


def gram_scores(grams: DataFrame, *, depth: int, top: int = 2) -> DataFrame:
    """(gram, log10_p): the code of each string's last byte after the others, for ``grams(gram, n)``."""
    top = min(top, depth)
    upper = upper_levels(grams, depth=depth, top=top)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _whole_contexts(batches):
            levels, places = subtree(gram, n, depth, top)
            node, bit = decisions(gram & np.uint64(0xFF))
            for length, level in reversed(list(enumerate(upper))):
                keys = (context_of(gram, length)[:, None] << np.uint64(8) | node.astype(np.uint64)).ravel()
                levels.insert(0, level)
                places.insert(0, np.searchsorted(level.keys, keys))
            p = mixed(levels, places, bit.ravel()).reshape(-1, 8)
            yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(np.log10(p).sum(1))], names=["gram", "log10_p"])

    return _by_context(grams, top).mapInArrow(run, "gram long, log10_p double")


# ---- scoring -------------------------------------------------------------------------------------


def chunk_of(docs: DataFrame, *, id_col: str, text_col: str, size: int = CHUNK) -> Column:
    """A row's chunk, the same in every scan: rows that follow one another in a file, or else a hash's share."""
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    try:
        docs.select("_metadata.row_index", "_metadata.file_path")
    except AnalysisException:
        return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 + total // size))
    each = max(1, rows * size // max(1, total))
    return F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / each))


class Lookup:
    """An open-addressed table from 64-bit keys to numbers, for many look-ups at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.used = np.zeros(1 << self.bits, bool)
        self.values = np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = ~self.used[at]
            _, first = np.unique(at[free], return_index=True)
            put = np.nonzero(free)[0][first]
            slots = at[put]
            self.used[slots], self.keys[slots], self.values[slots] = True, keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        while (missed := np.nonzero(self.keys[at] != keys)[0]).size:
            at[missed] = (at[missed] + 1) & ((1 << self.bits) - 1)
        return self.values[at]


def scores(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 4) -> DataFrame:
    """(doc_id, learned, n_bytes, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``learn`` marks the rows to learn from. ``score`` is the log10 probability of
    the text and its end symbol; ``base_score`` that of its words and end token
    under their add-one frequencies.
    """
    chunk = chunk_of(docs, id_col=id_col, text_col=text_col)
    rows = docs.select(chunk.alias("chunk"), learn.alias("learn"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    asked = written(requests(rows.select("chunk", "learn", "data"), depth=depth), "asked")
    words = asked.where("word is not null")
    grams = asked.where("gram is not null")
    vocabulary = written(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    counted = written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    scored = gram_scores(counted, depth=depth)
    told = words.select("chunk", "word").join(vocabulary.where("n > 0"), "word").select("chunk", "word", F.lit(None).cast("long").alias("gram"), F.col("n").cast("double").alias("x"))
    told = told.union(grams.select("chunk", "gram").join(scored, "gram").select("chunk", F.lit(None).cast("binary"), "gram", "log10_p"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, values = right.column("word"), right.column("x").to_numpy()
        is_word = words.is_valid().to_numpy()
        costs = dict(zip(words.filter(pa.array(is_word)).to_pylist(), np.log10((values[is_word] + 1) / (total + distinct + 1)).tolist()))
        unseen = -math.log10(total + distinct + 1)
        table = Lookup(right.column("gram").drop_null().to_numpy().view(np.uint64), values[~is_word])
        data = left.column("data").to_pylist()
        base, score, sizes = [], np.empty(len(data)), np.empty((len(data), 3), np.int64)
        for a, b in blocks(data):
            keys, lengths = symbols(data[a:b], depth)
            score[a:b] = np.add.reduceat(table.get(keys), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            for i in range(a, b):
                found = [costs.get(w) for w in tokens_of(data[i])]
                known = [x for x in found if x is not None]
                base.append(math.fsum(known) + unseen * (len(found) - len(known)))
                sizes[i] = len(data[i]), len(found), len(known)
        n = len(data)
        cols = [left.column("doc_id"), left.column("learn"), *(pa.array(sizes[:, i]) for i in range(3)), pa.array(np.full(n, total, np.int64)), pa.array(base, pa.float64()), pa.array(score)]
        return pa.table(cols, names=["doc_id", "learned", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType
    schema = keyed("doc_id", kind, "learned boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    found = scores(read_table(spark, sf_dir, "documents"), ~remainder_is("doc_id", 7, 2))
    bits = -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
