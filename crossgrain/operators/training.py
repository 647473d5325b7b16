"""Walk-forward training over folds and settings.

The panel is written once. Every fold and setting is a fit of its own, and the
fits are submitted side by side, as many as asked at a time, so the cluster is
not idle at one fit's ends. Predictions of all fits are one table; their measures
are aggregates of it by fold and setting.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from crossgrain.operators import metrics
from crossgrain.sources import files


def walk_forward(
    panel: DataFrame, features: Sequence[str], settings: Sequence[dict[str, Any]], *, folds: int = 4, horizon: int = 1, embargo: int = 0,
    label: str = "target", held: float = 0.15, parallel: int = 4, seed: int = 7,
) -> DataFrame:
    """(setting, fold, date, symbol, p, label, place, forward_return) of every fold's test block, by boosted trees of the dates before it.

    ``settings`` are options of ``GBTRegressor``, by their place. The last ``held`` of a fold's training dates stop the boosting.
    Rows that lack a feature or the label are left out; a ``place`` that the panel has is its label's, as ``metrics.placed`` has it; a fold without training or test dates has no rows.
    """
    rows = panel.dropna(subset=[*features, label])
    rows = rows.withColumn(label, F.col(label).cast("double"))
    rows = rows if "place" in panel.columns else metrics.placed(rows, label)  # a test block has its dates whole
    rows = files.written(VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows).select("date", "symbol", "_x", label, "place", "forward_return"), "walk")
    places = metrics.folds(rows, folds=folds, horizon=horizon, embargo=embargo)
    last = places.where("role = 'train'").groupBy("fold").agg(F.percentile(F.unix_date("date"), 1 - held).alias("_cut"))
    places = places.join(last, "fold").withColumn("role", F.when((F.col("role") == "train") & (F.unix_date("date") > F.col("_cut")), "held").otherwise(F.col("role"))).select("fold", "date", "role")
    places = files.written(places, "folds")  # a row a fold and date

    def fit(job: tuple[int, int]) -> DataFrame:
        k, fold = job
        own = rows.join(F.broadcast(places.where(F.col("fold") == fold)), "date")
        model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="p", validationIndicatorCol="_held", seed=seed, **settings[k]).fit(own.where("role <> 'test'").withColumn("_held", F.col("role") == "held"))
        return model.transform(own.where("role = 'test'")).select(F.lit(k).alias("setting"), F.lit(fold).alias("fold"), "date", "symbol", "p", label, "place", "forward_return")

    present = sorted(r.fold for r in places.groupBy("fold").agg(F.collect_set("role").alias("roles")).where("array_contains(roles, 'train') and array_contains(roles, 'test')").collect())
    jobs = list(product(range(len(settings)), present))
    spark = panel.sparkSession
    if not jobs:
        return spark.createDataFrame([], f"setting int, fold int, date date, symbol string, p double, {label} double, place double, forward_return double")
    with ThreadPoolExecutor(parallel) as pool:
        fits = list(pool.map(inheritable_thread_target(fit), jobs))
    found = fits[0]
    for other in fits[1:]:
        found = found.unionByName(other)
    return found


def measured(predictions: DataFrame, *keys: str, lags: int = 4, label: str = "target", min_names: int = metrics.MIN_NAMES) -> DataFrame:
    """(keys, rows, mse, direction, dates, mean_ic, icir, t): squared error, share of right signs, and the dates' rank IC with its Newey-West t.

    Where labels are ``placed`` already, in a column ``place``, they are not ranked again for each of the keys.
    """
    d = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.pow(F.col("p") - F.col(label), 2)).alias("mse"), F.avg((F.signum("p") == F.signum(label)).cast("double")).alias("direction"))
    ics = metrics.place_ic(predictions, *keys, "date", score="p", min_names=min_names) if "place" in predictions.columns else metrics.rank_ic(predictions, *keys, "date", label=label, score="p", min_names=min_names)
    ic = metrics.ic_summary(ics, lags, *keys)
    return d.join(ic, list(keys), "left").select(*keys, "rows", "mse", "direction", "dates", "mean_ic", "icir", "t")


def ranked(measures: DataFrame) -> DataFrame:
    """(setting, folds, mean_ic, worst_ic, mse, place) over the folds of each setting, the best mean IC first; a setting is a row."""
    d = measures.groupBy("setting").agg(F.count(F.lit(1)).alias("folds"), F.avg("mean_ic").alias("mean_ic"), F.min("mean_ic").alias("worst_ic"), F.avg("mse").alias("mse"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("mean_ic"), "setting")))
