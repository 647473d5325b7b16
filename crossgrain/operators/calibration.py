"""Calibration of scores to win rates: isotonic regression by pooled blocks, fitted apart from where it is read.

Adjacent blocks whose rates fall are pooled, in whatever order, with one result.
So the tasks of a sorted range pool their own rows first, and what they keep,
far fewer rows, is pooled again over ever fewer ranges, at last in one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.sources import files

#: Fewer outcomes than this say nothing; fixed value.
LEAST = 100
_BLOCK = "low double, high double, won double, n double"


def pooled(low: np.ndarray, high: np.ndarray, won: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks in order of score, adjacent ones pooled until their rates rise."""
    out: list[tuple[float, float, float, float]] = []
    for block in zip(low.tolist(), high.tolist(), won.tolist(), n.tolist()):
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            a, _, w, k = out.pop()
            block = (a, block[1], w + block[2], k + block[3])
        out.append(block)
    return out


@dataclass
class Calibrator:
    """Scores and rates between which is interpolated; a block of b rows has two, so n outcomes of two kinds make O(n^(2/3)) of them."""

    scores: np.ndarray
    rates: np.ndarray
    samples: int
    base_rate: float

    def calibrated(self, rows: DataFrame, score: str = "score", into: str = "p") -> DataFrame:
        """``rows`` with the rate of its score; beyond the ends it is that of the end, and null for a null score or one that is no number."""
        xs, ys = self.scores, self.rates

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = batch.column(names.index(score)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.interp(s, xs, ys), mask=np.isnan(s))], names=[*names, into])

        names = rows.columns
        return rows.mapInArrow(run, rows.withColumn(into, F.lit(None).cast("double")).schema)


def fitted(rows: DataFrame, *, score: str = "score", outcome: str = "outcome", least: int = LEAST, ranges: int | None = None) -> Calibrator | None:
    """A calibrator from scores and outcomes (won where above 0), or None with fewer than ``least`` or outcomes all alike.

    Rows whose score or outcome is null or not finite are left out; equal scores are one block from the start.
    """
    s, y = F.col(score).cast("double"), F.col(outcome).cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = rows.where(finite(s) & finite(y)).select(s.alias("low"), (y > 0).cast("double").alias("w"))
    d = d.groupBy("low").agg(F.col("low").alias("high"), F.sum("w").alias("won"), F.count(F.lit(1)).cast("double").alias("n"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[float, float, float, float]] = []
        for batch in batches:  # what is kept already goes on being pooled
            own = [c.to_numpy() for c in batch.columns]
            before = list(zip(*kept)) or [[]] * 4
            kept = pooled(*(np.concatenate([np.array(b, float), v]) for b, v in zip(before, own)))
        yield pa.record_batch([pa.array([k[i] for k in kept], pa.float64()) for i in range(4)], names=["low", "high", "won", "n"])

    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = files.written(d.select("low", "high", "won", "n").repartitionByRange(n, "low").sortWithinPartitions("low").mapInArrow(run, _BLOCK), "blocks")
    while n > 1:
        n = max(1, n // 8)
        last, blocks = blocks, files.written(blocks.repartitionByRange(n, "low").sortWithinPartitions("low").mapInArrow(run, _BLOCK), "blocks")
        files.discarded(last)
    found = sorted((r.low, r.high, r.won, r.n) for r in blocks.collect())
    files.discarded(blocks)
    samples, wins = sum(f[3] for f in found), sum(f[2] for f in found)
    if samples < least or wins in (0, samples):
        return None
    knots = [(x, w / k) for a, b, w, k in found for x in ((a, b) if b > a else (a,))]
    return Calibrator(np.array([x for x, _ in knots]), np.array([p for _, p in knots]), int(samples), wins / samples)
