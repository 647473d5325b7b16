"""Boosting by the rank-IC objective: trees fitted to the gradient of each date's correlation.

A round is: sums over dates give each training row the gradient, one tree is
fitted to it, and all rows' scores move a step along the tree. Scores are carried
in a written table from round to round, and the last round's table goes when the
next one is there, so the lineage stays short and an executor may be lost at any
time. Rounds are chosen by the validation dates' mean rank IC, not by a loss.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.frames import across, average_rank
from crossgrain.operators import metrics
from crossgrain.sources import files


def rank_label(panel: DataFrame, label: str = "forward_return") -> DataFrame:
    """Adds ``target``: the label's place among its date's, from -1 to 1."""
    return panel.withColumn("target", 2 * average_rank(label) / (F.count(F.lit(1)).over(across("date")) + 1) - 1)


def moments(panel: DataFrame, *, score: str = "score", label: str = "target") -> DataFrame:
    """What a date's correlation and its gradient need: a row a date."""
    named = {"_n": F.count(F.lit(1)), "_mp": F.avg(score), "_my": F.avg(label), "_vp": F.var_pop(score), "_vy": F.var_pop(label), "_py": F.covar_pop(score, label)}
    return panel.groupBy("date").agg(*[v.alias(k) for k, v in named.items()])


def ascent(panel: DataFrame, *, score: str = "score", label: str = "target", scaled: bool = False, dates: DataFrame | None = None) -> DataFrame:
    """Adds ``gradient`` of each date's correlation; where scores do not vary yet, its limit: the centred label over its length.

    A label that does not vary asks for nothing: 0. With ``scaled`` a date's gradient is times the length of its scores. Correlation
    does not depend on that length, but the plain gradient is inversely proportional to it: while scores are small, it overshoots.
    ``dates`` are the panel's ``moments``, if they are known; rows meet them as they lie and are put in no order.
    """
    d = panel.join(F.broadcast(moments(panel, score=score, label=label) if dates is None else dates), "date")  # a row a date
    length, own = F.sqrt(F.col("_vy") * F.col("_n")), F.sqrt(F.col("_vp") * F.col("_n"))
    y = F.col(label) - F.col("_my")
    limit = F.when(length > 1e-12, y / length).otherwise(0.0)
    p, unit = F.try_divide(F.col(score) - F.col("_mp"), own), F.try_divide(y, length)
    correlation = F.try_divide(F.col("_py") * F.col("_n"), own * length)
    gradient = F.try_divide(unit - correlation * p, F.lit(1.0) if scaled else own)
    return d.select(*panel.columns, F.coalesce(gradient, limit).alias("gradient"))


def mean_correlation(panel: DataFrame, *, score: str = "score", label: str = "target", min_names: int = metrics.MIN_NAMES) -> DataFrame:
    """(objective, dates): the mean over dates of the correlation; dates of few names or of one value on a side do not count."""
    return mean_of_moments(moments(panel, score=score, label=label), min_names)


def mean_of_moments(dates: DataFrame, min_names: int = metrics.MIN_NAMES) -> DataFrame:
    a, b = F.sqrt("_vp"), F.sqrt("_vy")
    d = dates.select(F.try_divide(F.col("_py"), a * b).alias("c"), F.col("_n").alias("n"), a.alias("a"), b.alias("b"))
    d = d.where((F.col("n") >= min_names) & (F.col("a") > 1e-12) & (F.col("b") > 1e-12))
    return d.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("objective"), F.count(F.lit(1)).alias("dates"))


@dataclass
class Boosted:
    """Trees that are summed, each ``rate`` times, and how training went: (round, train_objective, validation_ic) a round."""

    features: list[str]
    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    history: list[tuple[int, float, float]] = field(default_factory=list)
    kept: int = 0

    def assembled(self, panel: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="error").transform(panel)

    def scored(self, panel: DataFrame, into: str = "score") -> DataFrame:
        """``panel`` with the sum of the trees that were kept; a row that lacks a feature has no score."""
        whole = F.forall(F.array(*[F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in self.features]), lambda ok: ok)
        rows, total = self.assembled(panel.where(whole)), F.lit(0.0)
        for k, tree in enumerate(self.trees[: self.kept]):
            rows = tree.setPredictionCol(f"_p{k}").transform(rows)
            total = total + self.rate * F.col(f"_p{k}")
        lacking = panel.where(~whole).withColumn(into, F.lit(None).cast("double"))
        return rows.withColumn(into, total).select(*[c for c in panel.columns if c != into], into).unionByName(lacking)


def rank_ic_boosted(
    panel: DataFrame, features: Sequence[str], *, rounds: int = 100, rate: float = 0.1, depth: int = 3, least: int = 20, bins: int = 32,
    subsample: float = 1.0, patience: int = 10, scaled: bool = True, min_names: int = metrics.MIN_NAMES, seed: int = 7,
) -> Boosted:
    """Trees for the ``target`` of rows (date, symbol, role, features) whose role is train; the number of rounds by those of validation.

    Rows that lack a feature or the target are left out; a ``place`` that the panel has is its target's, as ``metrics.placed`` has it. With ``subsample`` a round sees that share of the training dates, whole
    dates at a time, as a gradient is one of a whole date. Without validation rows all rounds are kept.
    """
    model = Boosted(list(features), rate)
    rows = panel.where(F.col("role").isin("train", "validation")).dropna(subset=[*features, "target"])
    rows = rows if "place" in panel.columns else metrics.placed(rows, "target")
    table = files.written(model.assembled(rows).select("date", "symbol", "role", "target", "place", "_x", F.lit(0.0).alias("score")), "boosted-0")
    dates = files.written(moments(table.where("role = 'train'")), "moments-0")
    best = float("-inf")
    for number in range(1, rounds + 1):
        own = ascent(table.where("role = 'train'"), scaled=scaled, dates=dates)
        if subsample < 1:
            drawn = F.pmod(F.xxhash64("date", F.lit(seed + number)), F.lit(1_000_000)) < int(subsample * 1_000_000)
            own = own.where(drawn)
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="gradient", maxDepth=depth, minInstancesPerNode=least, maxBins=bins, seed=seed + number).fit(own)
        if tree.depth == 0 and tree.numNodes == 1 and not float(own.agg(F.max(F.abs("gradient"))).first()[0] or 0.0):
            break  # the gradient vanished
        model.trees.append(tree)
        moved = tree.setPredictionCol("_p").transform(table).withColumn("score", F.col("score") + rate * F.col("_p")).drop("_p")
        last, table = table, files.written(moved, f"boosted-{number}")
        files.discarded(last)
        dates = files.written(moments(table.where("role = 'train'")), f"moments-{number}")
        objective = mean_of_moments(dates, min_names).first().objective
        ic = metrics.place_ic(table.where("role = 'validation'"), min_names=min_names).agg(F.avg("ic")).first()[0]
        model.history.append((number, objective, ic))
        if ic is None:
            model.kept = number
        elif ic > best:
            best, model.kept = ic, number
        elif number - model.kept >= patience:
            break
    files.discarded(table)
    return model


def training_report(model: Boosted, spark) -> DataFrame:
    """(round, train_objective, validation_ic, kept): a row a round."""
    rows = [(n, o, i, n <= model.kept) for n, o, i in model.history]
    return spark.createDataFrame(rows, "round int, train_objective double, validation_ic double, kept boolean")
