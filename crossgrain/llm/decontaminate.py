"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` words (an item of fewer
words is one window), and every window into word shingles. All shingles of all
windows are ordered by rarity: the number of times the corpus holds them. A
window needs ``ceil(least * m)`` of its ``m`` shingles, so one of its
``m - needed + 1`` rarest, its prefix, must occur in a document that holds it.
Documents are probed with prefix shingles alone. A hit at word ``p`` for a
shingle at place ``j`` of the window puts the document's window at ``p - j``
(positional bound), which must lie inside the document (length bound); the
document's window of the same size is then compared shingle by shingle. With
``least`` 1 that is exact containment.

The documents stay where they are: the windows, in blocks of ``block`` at most,
are sent to the tasks that scan the documents, and there is one pass for each
block. A benchmark within one block, the usual case, needs one counting pass and
one probing pass and no shuffle of texts.

Defined cases: null and wordless texts have no words and are clean; a null or
wordless item has no window; equal items count once each; equal document rows
each get their row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import as_row, keyed, named, read_table, unpacked, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Distinct windows sent to the executors at once; about 1 kB each in a worker.
BLOCK = 100_000


def words_of(data: bytes | None) -> list[bytes]:
    return WORD.findall(data.lower()) if data else []


def shingles_of(words: list[bytes], width: int) -> list[bytes]:
    """Word shingles in order, repeats included; fewer words than ``width`` are one shingle."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)))]


def item_windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """(item_id, words): one row per item and distinct window, the words joined by spaces."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("binary").alias("data"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(data)
                found = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()
                ids += [item] * len(found)
                texts += found
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["item_id", "words"])

    return rows.mapInArrow(run, "item_id string, words binary")


def shingle_counts(docs: DataFrame, wanted: DataFrame, *, width: int) -> DataFrame:
    """(shingle, n): how often the corpus ``docs(data)`` holds each shingle of ``wanted(shingle)``."""
    shingles = frozenset(wanted.select("shingle").toArrow().column(0).to_pylist())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        firsts = {x.split(b" ", 1)[0] for x in shingles}
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")).to_pylist():
                words = words_of(data)
                if 0 < len(words) <= width:
                    counts.update(x for x in shingles_of(words, width) if x in shingles)
                    continue
                for i, word in enumerate(words[: len(words) - width + 1]):
                    if word in firsts and (x := b" ".join(words[i : i + width])) in shingles:
                        counts[x] += 1
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["shingle", "n"])

    return docs.mapInArrow(run, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


class Index:
    """Prefix shingles of a block of windows, and the comparison of what they find."""

    def __init__(self, windows: dict[bytes, list[str]], prefixes: dict[bytes, list[tuple[bytes, int]]], width: int, least: float) -> None:
        self.items, self.width, self.least = windows, width, least
        self.words = {w: w.split(b" ") for w in windows}
        self.long: dict[bytes, list[tuple[bytes, int]]] = defaultdict(list)
        self.short: dict[bytes, list[bytes]] = defaultdict(list)
        for shingle, places in prefixes.items():
            for window, at in places:
                if len(self.words[window]) < width:
                    self.short[self.words[window][0]].append(window)  # windows shorter than a shingle
                else:
                    self.long[shingle].append((window, at))
        self.firsts = {x.split(b" ", 1)[0] for x in self.long}

    def _same(self, window: bytes, words: list[bytes], start: int) -> bool:
        want = self.words[window]
        if start < 0 or start + len(want) > len(words):
            return False
        have = words[start : start + len(want)]
        if self.least >= 1 or have == want:
            return have == want
        a, b = shingles_of(want, self.width), shingles_of(have, self.width)
        return sum(x == y for x, y in zip(a, b)) >= math.ceil(self.least * len(a))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, window) of every occurrence in a document; one may come more than once."""
        width, long, firsts = self.width, self.long, self.firsts
        for i, word in enumerate(words):
            if word in firsts:
                for window, at in long.get(b" ".join(words[i : i + width]), ()):
                    if self._same(window, words, i - at):
                        yield i - at, i - at + len(self.words[window]), window
            if word in self.short:
                for window in self.short[word]:
                    if self._same(window, words, i):
                        yield i, i + len(self.words[window]), window


def _probe(docs: DataFrame, index: Index) -> DataFrame:
    """``docs(doc_id, data, spans, items)`` with what one block of windows finds added."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, data in enumerate(batch.column(1).to_pylist()):
                found = list(index.find(words_of(data)))
                if found:
                    spans[k] = merged([(x["start"], x["end"]) for x in spans[k]] + [x[:2] for x in found])
                    items[k] = sorted({*items[k], *(i for w in {x[2] for x in found} for i in index.items[w])})
            kind = batch.schema.field(2).type
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The union of half-open spans, in order, as disjoint spans."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, least: float = 1.0, block: int = BLOCK
) -> DataFrame:
    """(doc_id, data, spans, items) for every row of ``docs``.

    ``spans`` are the hit word ranges, disjoint and in order; ``items`` the
    sorted ids, as strings, of the items with a window in the document.
    """
    spark = docs.sparkSession
    windows = written(item_windows(items, id_col=item_col, text_col=item_text_col, window=window).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows")
    n = windows.count()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    out = out.withColumns({"spans": F.array().cast("array<struct<start:int,end:int>>"), "items": F.array().cast("array<string>")})
    blocks = -(-n // block)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, x, j) for w in batch.column(0).to_pylist() for j, x in enumerate(shingles_of(w.split(b" "), shingle))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.binary(), pa.binary(), pa.int32()))], names=["words", "shingle", "at"])

    source = out.select("data")
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) if blocks > 1 else windows
        places = own.select("words").mapInArrow(cut, "words binary, shingle binary, at int")
        counts = shingle_counts(source, places.select("shingle").distinct(), width=shingle)
        ranked = places.join(counts, "shingle", "left").withColumns(
            {
                "place": F.row_number().over(Window.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "shingle", "at")),
                "m": F.count("*").over(Window.partitionBy("words")),
            }
        )
        prefix = ranked.where(F.col("place") <= F.col("m") - F.ceil(F.col("m") * F.lit(float(least))) + 1)
        chosen: dict[bytes, list[tuple[bytes, int]]] = defaultdict(list)
        for row in prefix.select("shingle", "words", "at").toArrow().to_pylist():
            chosen[row["shingle"]].append((row["words"], row["at"]))
        held = {r["words"]: r["items"] for r in own.toArrow().to_pylist()}
        out = _probe(out, Index(held, dict(chosen), shingle, least))
        if k + 1 < blocks:
            out = written(out, "probed")
    return out


def summary(found: DataFrame) -> DataFrame:
    """The counts of the contract from (doc_id, data, spans, items)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(3).to_pylist()
            hit = [sum(x["end"] - x["start"] for x in s) for s in batch.column(2).to_pylist()]
            cols = [
                batch.column(0),
                pa.array([len(words_of(x)) for x in batch.column(1).to_pylist()], pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array([x > 0 for x in hit]),
            ]
            yield pa.record_batch(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = found.schema["doc_id"].dataType
    return found.mapInArrow(run, keyed("doc_id", kind, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"))


def decontaminated(docs: DataFrame, items: DataFrame, *, most: int = 0, **options) -> DataFrame:
    """The rows of ``docs`` whose texts have at most ``most`` hit words; all columns and repeated rows are kept.

    ``options`` are those of ``contamination``.
    """
    text_col = options.pop("text_col", "text")
    rows = docs.select(as_row(docs), named(text_col).alias("text"))
    found = contamination(rows, items, id_col="row", text_col="text", **options)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return unpacked(found.where(hit <= most).withColumnRenamed("doc_id", "row"), docs)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, for 10-word windows."""
    return summary(contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
