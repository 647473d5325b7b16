"""Target-distribution importance resampling: hashed n-gram weights, Gumbel keys, exact top share.

Counts of hashed n-grams over the raw and the target texts give each bucket a
gain, the scaled log ratio of its smoothed shares. The gains are one array of
``buckets`` numbers; a document's weight is the sum of the array over its
features, and its score adds keyed Gumbel noise, so that the highest scores are
a draw without replacement in proportion to the weights.

The cutoff is found by weighted median-of-medians selection. Scored rows are
written once, each task's in order of their keys, so a task's share of what
remains is a range of its places and its median is one row. The median of those
medians, weighted by what remains in each, has at least a quarter of what
remains on either side; counting what comes before it says which side goes.
Rounds repeat until a pivot is the last key to be drawn. Only medians and counts
of tasks leave the executors. Then only the winners are sorted, by ranges.

Defined cases: a null text has no words; a document of fewer than ``least_words``
words is scored and never drawn; ties of score go to the smaller id, a null id
first, and ties of both to what was written first; equal rows are drawn each; an
empty table gives no rows; without a target every gain compares with nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.common import keyed, named, read_table, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BUCKETS, KEY, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Words (or runs of words) a task remembers the bucket of.
_REMEMBERED = 200_000


class Hashed:
    """text -> (number of words, buckets of its features)."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets, self.known = width, buckets, {}

    def bucket(self, feature: str) -> int:
        if (found := self.known.get(feature)) is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            found = self.known[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        words = WORD.findall((text or "").translate(_LOWER))
        features = (words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)))) for n in range(1, self.width + 1))
        return len(words), np.fromiter((self.bucket(f) for own in features for f in own), np.int64)


def bucket_counts(docs: DataFrame, *, text_col: str = "text", width: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: an array of fixed size, summed by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, sums = Hashed(width, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                sums += np.bincount(hashed(text.as_py())[1], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for r in docs.select(named(text_col)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over its share in the raw texts."""
    buckets, in_raw, in_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (in_raw + buckets) / (float(s + 1) * (in_target + buckets)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", width: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row; ``gain`` is all a task needs, and of fixed size."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(width, len(gain))
        for batch in batches:
            out = [(n, len(f), int(gain[f].sum())) for n, f in (hashed(text.as_py()) for text in batch.column(1))]
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in out], pa.int64()) for i in range(3))], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, keyed("doc_id", rows.schema[0].dataType, "n_words long, n_features long, weight long"))


def gumbel(id_: Column, key: int) -> Column:
    """floor(1000 times) a standard Gumbel draw, keyed by the id's text (a null id: the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def in_order() -> tuple[Column, ...]:
    """Keys in the order of drawing; ``place`` makes each its own."""
    return F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("place")


def placed(rows: DataFrame, label: str, *order: Column) -> DataFrame:
    """``rows`` written, each task's in order, with ``place``: the task's number and the row's place there."""
    return written(rows.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), label)


def before(pivot: dict) -> Column:
    """True for keys that come no later than the pivot."""
    score, place = F.col("score"), F.col("place")
    same, id_ = F.lit(pivot["place"]), F.col("doc_id")
    if pivot["doc_id"] is None:
        ties = id_.isNull() & (place <= same)
    else:
        ties = id_.isNull() | (id_ < F.lit(pivot["doc_id"])) | ((id_ == F.lit(pivot["doc_id"])) & (place <= same))
    return (score > pivot["score"]) | ((score == pivot["score"]) & ties)


def cutoff(keys: DataFrame, draw: int) -> tuple[dict, int]:
    """The key that is ``draw``-th in order, and the rounds it took: weighted median of medians.

    ``keys`` is a written table of (score, doc_id, place), each task's rows in order and numbered by ``placed`` from 0 without gaps.
    The driver holds a range of places for each task, and sorts their medians.
    """
    spark = keys.sparkSession
    task, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    keys = keys.withColumn("task", task).withColumn("row", row)
    ranges = {r.task: (0, r.n) for r in keys.groupBy("task").agg(F.count("*").alias("n")).collect()}
    rounds = 0
    while True:
        rounds += 1
        remaining = [(t, (a + b) // 2, b - a) for t, (a, b) in ranges.items() if b > a]
        if not remaining:
            raise ValueError("fewer keys than are to be drawn")
        asked = F.broadcast(spark.createDataFrame(remaining, "task long, row long, weight long"))  # one row a task
        medians = keys.join(asked, ["task", "row"]).select("score", "doc_id", "place", "weight")
        half, seen = sum(w for _, _, w in remaining) / 2, 0
        for r in medians.orderBy(*in_order()).collect():
            pivot, seen = r.asDict(), seen + r.weight
            if seen >= half:
                break
        upto = {r.task: r.n for r in keys.where(before(pivot)).groupBy("task").agg(F.count("*").alias("n")).collect()}
        rank = sum(upto.values())
        if rank == draw:
            return pivot, rounds
        if rank > draw:  # the pivot itself comes too late
            own = pivot["place"] >> 33
            ranges = {t: (a, max(a, min(b, upto.get(t, 0) - (t == own)))) for t, (a, b) in ranges.items()}
        else:
            ranges = {t: (min(b, max(a, upto.get(t, 0))), b) for t, (a, b) in ranges.items()}


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 in order: sorted by ranges, each task's rows counted on from those of earlier tasks."""
    spark = rows.sparkSession
    out = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = sorted((r.task, r.n) for r in out.groupBy(F.shiftright("_at", 33).alias("task")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 1
    for t, n in sizes:
        starts.append((t, at))
        at += n
    first = F.broadcast(spark.createDataFrame(starts, "_task long, _first long"))  # one row a task
    ranked = out.join(first, F.shiftright("_at", 33) == F.col("_task"))
    return ranked.withColumn("rank", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_task", "_first")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    width: int = 1, buckets: int = BUCKETS, key: int = KEY, percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; ``rank`` is null for what is not drawn."""
    gain = gains(bucket_counts(docs, text_col=text_col, width=width, buckets=buckets), bucket_counts(target, text_col=target_text, width=width, buckets=buckets))
    rows = scored(docs, gain, id_col=id_col, text_col=text_col, width=width).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), key))
    fit = F.col("n_words") >= least_words
    # Rows that may be drawn come first in each task, so that these have the places from 0 on.
    rows = placed(rows, "scores", fit.desc(), F.desc("score"), F.asc_nulls_first("doc_id"))
    columns = ["doc_id", "n_features", "weight", "score"]
    nothing = F.lit(None).cast("long").alias("rank")
    draw = percent * rows.where(fit).count() // 100
    if not draw:
        return rows.select(*columns, nothing)
    last, _ = cutoff(rows.where(fit).select("score", "doc_id", "place"), draw)
    drawn = fit & before(last)
    return rows.where(~drawn).select(*columns, nothing).unionByName(numbered(rows.where(drawn).select(*columns, "place"), *in_order()).select(*columns, "rank"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
