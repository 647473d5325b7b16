"""Neutralization against any number of exposures: one least-squares fit a date, from sums.

Group membership is absorbed by demeaning within (date, group), which is the
same projection as a dummy a group. What is left needs a date's products of
exposures, k x k numbers, whatever the number of names: Spark sums them, a batch
of dates is solved at once, and the coefficients, one row a date, go back to the
rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.operators.metrics import MIN_NAMES
from crossgrain.sources import files

#: A residual that varies less than this share of what the score did is rounding noise, and set to 0; fixed value.
COLLAPSE = 1e-8
#: Directions of exposures that vary less than this share of the strongest are not told apart from others.
RANK = 1e-10


def solved(products: np.ndarray, with_score: np.ndarray) -> np.ndarray:
    """Minimum-norm coefficients of many dates: products (dates, k, k), with_score (dates, k).

    Exposures are brought to one scale first; repeated or constant ones share or get no coefficient.
    """
    scale = np.sqrt(np.einsum("dii->di", products))
    unit = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0.0)
    values, vectors = np.linalg.eigh(products * unit[:, :, None] * unit[:, None, :])
    keep = values > RANK * np.maximum(values[:, -1:], 0)
    inverse = np.where(keep, 1 / np.where(keep, values, 1), 0.0)
    return unit * np.einsum("dij,dj,dkj,dk->di", vectors, inverse, vectors, unit * with_score)


def neutralized(panel: DataFrame, exposures: Sequence[str], *, score: str = "score", group: str | None = None, min_names: int = MIN_NAMES) -> DataFrame:
    """Rows of ``panel`` with ``residual``: the score less its least-squares fit on an intercept, the exposures and a dummy a group.

    Rows that lack the score or an exposure are left out, a null group is a group. A date of fewer than max(min_names, k + 2)
    rows, k counting exposures and the date's groups, or with an infinite exposure, is left out. A residual that all but vanishes
    is 0 for the whole date. Columns whose names begin with an underscore are the operator's own.
    """
    names = list(exposures)
    rows = panel.dropna(subset=[score, *names])
    rows = files.written(rows.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("\0")) if group else F.lit("")), "exposed")  # read once for each of the sums below
    infinite = F.max(F.exists(F.array(*[F.col(c).cast("double") for c in names]), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).cast("int")) if names else F.max(F.lit(0))
    means = {"_m": F.avg(score), **{f"_m{i}": F.avg(c) for i, c in enumerate(names)}}
    groups = files.written(rows.groupBy("date", "_g").agg(F.count(F.lit(1)).alias("_n"), infinite.alias("_infinite"), *[v.alias(c) for c, v in means.items()]), "groups")
    k = F.lit(len(names)) + (F.count(F.lit(1)) if group else F.lit(0))
    fit = groups.groupBy("date").agg(k.alias("_k"), F.sum("_n").alias("_n"), F.max("_infinite").alias("_infinite")).where((F.col("_infinite") == 0) & (F.col("_n") >= F.greatest(F.lit(min_names), F.col("_k") + 2))).select("date")
    rows = rows.join(groups.join(F.broadcast(fit), "date").select("date", "_g", *means), ["date", "_g"])  # a row a date and group
    rows = rows.withColumns({"_y": F.col(score) - F.col("_m"), **{f"_e{i}": F.col(c) - F.col(f"_m{i}") for i, c in enumerate(names)}})
    if names:
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        sums = [F.sum(F.col(f"_e{i}") * F.col(f"_e{j}")).alias(f"p{i}_{j}") for i, j in pairs] + [F.sum(F.col(f"_e{i}") * F.col("_y")).alias(f"q{i}") for i in range(len(names))]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
                products = np.empty((batch.num_rows, len(names), len(names)))
                for (i, j), v in zip(pairs, got):
                    products[:, i, j] = products[:, j, i] = v
                found = solved(products, np.stack(got[len(pairs) :], 1))
                yield pa.record_batch([batch.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["date", "_b"])

        fits = rows.groupBy("date").agg(*sums).mapInArrow(run, "date date, _b array<double>")  # one row a date
        rows = rows.join(F.broadcast(files.written(fits, "fits")), "date").withColumn("_y", F.col("_y") - sum((F.col("_b")[i] * F.col(f"_e{i}") for i in range(len(names))), F.lit(0.0)))
    whole = rows.groupBy("date").agg(F.stddev_pop(score).alias("_spread"), F.sqrt(F.avg(F.col("_y") * F.col("_y"))).alias("_left"))
    rows = rows.join(F.broadcast(whole), "date")  # a row a date
    return rows.withColumn("residual", F.when((F.col("_spread") > 0) & (F.col("_left") <= COLLAPSE * F.col("_spread")), 0.0).otherwise(F.col("_y"))).select(*panel.columns, "residual")
