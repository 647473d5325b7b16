"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed from left to right: the next phrase is the shortest
string not yet in the text's dictionary, which it then joins. Texts that share
long passages come to share phrases, as a compressor would find them. The
phrases are hashed and the ``size`` smallest hashes are the fingerprint; the
share of common hashes among the ``size`` smallest of two texts' union estimates
the Jaccard similarity of their phrase sets.

Neighbours by id are brought together without one task seeing all rows: ids of any
kind are cut into ranges, each range is ordered in its own task, and the first row
of every range is also dealt to the range before it.

Defined cases: null is the empty text, whose fingerprint is empty; two empty
fingerprints have likeness 1, an empty and another 0; equal texts have equal
fingerprints; rows that share an id follow one another by their texts' hashes and
texts, null ids first; a table of one row is its own next document; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from crossgrain.llm.common import keyed, named, read_table, spread

SIZE = 256


class Parse:
    """The dictionary and hashes of a text parsed so far; more text may be added."""

    def __init__(self, seed: int = 0) -> None:
        self.seed, self.known, self.open, self.longest = seed, {b"": None}, b"", 1
        self.done = np.empty(0, np.uint64)  # hashes of the first phrases

    @property
    def phrases(self) -> set[bytes]:
        return set(self.known) - {b""}

    def add(self, data: bytes) -> Parse:
        """Reads on; an unfinished phrase is kept open.

        The dictionary holds each phrase's beginnings, so the longest known string is found from the last length, up or down.
        """
        known, longest = self.known, self.longest
        data = self.open + data
        at, n, size = 0, len(data), 3
        while at + longest < n:  # no known string reaches the end
            end = at + size
            phrase = data[at:end]
            if phrase in known:
                while phrase in known:
                    end += 1
                    phrase = data[at:end]
            else:
                while (shorter := data[at : end - 1]) not in known:
                    phrase = shorter
                    end -= 1
            known[phrase] = None
            size = end - at
            if size > longest:
                longest = size
            at, size = end, size - 1 or 1
        while at < n:
            end = at + 1
            while end <= n and data[at:end] in known:
                end += 1
            if end > n:
                break
            known[data[at:end]] = None
            longest = max(longest, end - at)
            at = end
        self.open, self.longest = data[at:], longest
        return self

    def copy(self) -> Parse:
        """The same state; hashes made so far are shared."""
        self._hash()
        out = Parse(self.seed)
        out.known, out.open, out.longest, out.done = dict(self.known), self.open, self.longest, self.done
        return out

    def _hash(self) -> None:
        new = islice(self.known, 1 + len(self.done), None)
        digest, seed = xxhash.xxh64_digest, self.seed
        made = np.frombuffer(b"".join([digest(p, seed) for p in new]), ">u8").astype(np.uint64)
        self.done = np.concatenate([self.done, made]) if len(self.done) else made

    def hashes(self, size: int) -> np.ndarray:
        """The ``size`` smallest hashes of the phrases, in order; an unfinished phrase is in the dictionary already."""
        self._hash()
        return np.unique(np.partition(self.done, size - 1)[:size] if len(self.done) > size else self.done)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two phrase sets from their smallest hashes, each in order."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~again])][:size]
    return float((both[1:][again] <= union[-1]).sum() / len(union))


def digest_of(hashes: np.ndarray) -> str:
    """The signature as text: 16 hex digits for each hash."""
    return hashes.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, seed: int = 0) -> DataFrame:
    """(doc_id, fingerprint) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([digest_of(Parse(seed).add(x or b"").hashes(size)) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, keyed("doc_id", rows.schema[0].dataType, "fingerprint string"))


def with_ranges(docs: DataFrame, *, ranges: int, sample: int = 10_000) -> DataFrame:
    """(doc_id, text, home, guest): rows by ranges of (id, text's hash), the first of each range also as a guest of the range before.

    The first range's first is a guest of the last. The cuts are taken from the ``sample`` rows of the smallest hashes, so that
    ranges are about alike whatever the ids; they and one first for each range are all that comes to the driver.
    """
    keyed_rows = docs.withColumn("at", F.struct("doc_id", F.xxhash64("text").alias("h")))
    kind = keyed_rows.schema["at"].dataType
    spark = docs.sparkSession
    homes = F.lit(0)
    if ranges > 1:
        drawn = keyed_rows.select("at").distinct().orderBy(F.xxhash64("at"), "at").limit(sample)
        cut = F.ntile(ranges).over(Window.partitionBy(F.lit(0)).orderBy("at"))
        cuts = [r.at for r in drawn.withColumn("n", cut).groupBy("n").agg(F.min("at").alias("at")).where("n > 1").collect()]
        if cuts:
            bounds = spark.createDataFrame([(cuts,)], StructType([StructField("cuts", ArrayType(kind))]))
            keyed_rows = keyed_rows.crossJoin(F.broadcast(bounds))  # one row of ``ranges`` bounds
            homes = F.size(F.filter("cuts", lambda c: c <= F.col("at")))
    homed = keyed_rows.withColumn("home", homes)
    firsts = sorted((r.home, r.low) for r in homed.groupBy("home").agg(F.min("at").alias("low")).collect())
    visits = [(low, firsts[i - 1][0]) for i, (_, low) in enumerate(firsts)]
    table = spark.createDataFrame([(visits,)], StructType([StructField("visits", ArrayType(StructType([StructField("low", kind), StructField("home", IntegerType())])))]))
    seats = F.concat(F.array(F.struct("home", F.lit(False).alias("guest"))), F.transform(F.filter("visits", lambda v: v["low"].eqNullSafe(F.col("at"))), lambda v: F.struct(v["home"].alias("home"), F.lit(True).alias("guest"))))
    return homed.crossJoin(F.broadcast(table)).select("doc_id", "text", "at", F.explode(seats).alias("seat")).select("doc_id", "text", "at", "seat.home", "seat.guest")


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, seed: int = 0, ranges: int | None = None, texts: bool = True) -> DataFrame:
    """Every row with the fingerprint of its text, of its edited text and of the next document's text.

    The edit replaces the last quarter of the code points by as many, or all, of the first of the next document. ``edited``
    is null without ``texts``; its digest is always there.
    """
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    ranges = ranges or spread(docs.sparkSession)
    seated = with_ranges(rows, ranges=ranges).repartitionById(ranges, F.col("home")).sortWithinPartitions("home", "guest", "at", "text").drop("at")
    names = ["doc_id", "n_chars", "edited", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            last = None
            for batch in batches:
                for row in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
                    if last is not None and last[2] == row[2] and not last[3]:
                        yield last, row
                    last = row

        def parsed(text: str) -> tuple[str, Parse, np.ndarray]:
            """A text, the parse of its first three quarters, and the hashes of all of it."""
            head = len(text) - len(text) // 4
            begun = Parse(seed).add(text[:head].encode())
            return text, begun, begun.copy().add(text[head:].encode()).hashes(size)

        def given(rows: list[tuple]) -> pa.RecordBatch:
            ids, *cols = zip(*rows)
            return pa.record_batch([pa.array([x.as_py() for x in ids], ids[0].type), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

        now: tuple[str, Parse, np.ndarray] | None = None  # the next document, if just parsed
        out = []
        for (doc_id, text, _, _), (_, following, _, _) in pairs():
            _, begun, own = now if now and now[0] == text else parsed(text)
            now = parsed(following)
            tail = len(text) // 4
            edited = text[: len(text) - tail] + following[:tail]
            changed = begun.add(following[:tail].encode()).hashes(size)
            out.append((doc_id, len(text), edited if texts else None, hashlib.sha256(edited.encode()).hexdigest(), digest_of(own), digest_of(changed), likeness(own, changed, size), likeness(own, now[2], size)))
            if len(out) == 500:
                yield given(out)
                out = []
        if out:
            yield given(out)

    return seated.mapInArrow(run, keyed("doc_id", rows.schema["doc_id"].dataType, "n_chars long, edited string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))


def op9_lzprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return edited_pairs(read_table(spark, sf_dir, "documents"), texts=False).drop("edited")
