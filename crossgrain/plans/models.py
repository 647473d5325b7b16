"""Named features over the bucketed bar store (W23, A13) and models of the cross-section: neutralization against several exposures (M1, G15), rolling pairs (M4), calibration (M5), rank-IC boosting (M9), boosted trees and their inputs' weight (M7, M8, G38), walk-forward training and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding
from crossgrain.operators import boosting, calibration, exposures, features, market, metrics, pit, planner, studies, training
from crossgrain.plans.common import ic_sql, out, scored, scored_sql, sql
from crossgrain.plans.evaluation import SUMMARY, nw_sql
from crossgrain.plans.features import frame
from crossgrain.plans.grouped import M2, with_exposures
from crossgrain.plans.market import PRED, predictions
from crossgrain.plans.pit import SECTORS, sectors
from crossgrain.plans.registry import query
from crossgrain.sources import files
from crossgrain.sources.bars import bars, bars_sql, store_bars

# ---- neutralization ------------------------------------------------------------------------------

EXPOSED = f"""v AS (SELECT symbol, date, close * volume AS v FROM b), sz AS (SELECT symbol, date, {frame('median($)', 'v', 60, 20)} AS m FROM v), {SECTORS},
 ex AS (SELECT p.date, p.symbol, score, forward_return, iv.beta AS x, ln(sz.m) AS z, coalesce(sector, 'UNKNOWN') AS sector FROM p JOIN iv ON iv.symbol = p.symbol AND iv.date = p.date JOIN sz ON sz.symbol = p.symbol AND sz.date = p.date LEFT JOIN sc ON sc.symbol = p.symbol WHERE iv.beta IS NOT NULL AND sz.m IS NOT NULL),
 en AS (SELECT * FROM ex JOIN (SELECT date FROM ex GROUP BY date HAVING count(*) >= greatest(5, 2 + count(DISTINCT sector) + 2)) USING (date)),
 ec AS (SELECT *, score - avg(score) OVER g AS y, x - avg(x) OVER g AS xe, z - avg(z) OVER g AS ze FROM en WINDOW g AS (PARTITION BY date, sector)),
 eg AS (SELECT date, sum(xe * xe) AS xx, sum(xe * ze) AS xz, sum(ze * ze) AS zz, sum(xe * y) AS xy, sum(ze * y) AS zy FROM ec GROUP BY date),
 rs AS (SELECT date, symbol, sector, score, forward_return, y - (xy * zz - zy * xz) / (xx * zz - xz * xz) * xe - (zy * xx - xy * xz) / (xx * zz - xz * xz) * ze AS residual FROM ec JOIN eg USING (date))"""


def residuals(spark, sf) -> DataFrame:
    """Momentum less what market beta, traded value and sectors explain of it."""
    d = pit.sectors_of(with_exposures(spark, sf), sectors(spark, sf))
    return exposures.neutralized(d, ["beta", "size"], group="sector")


@query("M1_neutralized_exposures", sql(scored_sql(), M2, EXPOSED, select="SELECT date, symbol, sector, round(residual, 6) AS residual FROM rs"))
def m1(spark, sf):
    return out(residuals(spark, sf).select("date", "symbol", "sector", "residual"))


@query("G15_neutralized_exposures", sql(scored_sql(), M2, EXPOSED, ic_sql(source="rs"), ic_sql(source="(SELECT date, round(residual, 9) AS residual, forward_return FROM rs)", score="residual").replace("ic AS", "ir AS", 1), select="SELECT round(avg(ic.ic), 5) AS raw_ic, round(avg(ir.ic), 5) AS residual_ic, round(avg(ir.ic) / avg(ic.ic), 4) AS retained, count(*) AS dates FROM ic JOIN ir USING (date)"))
def g15(spark, sf):
    """Raw and residual rank IC on the same dates, and the share retained."""
    d = residuals(spark, sf).withColumn("residual", rounding("residual", 9))
    both = metrics.rank_ics(d, ("score", "residual"))
    raw, left = F.avg("ic_score"), F.avg("ic_residual")
    return both.agg(rounding(raw, 5).alias("raw_ic"), rounding(left, 5).alias("residual_ic"), rounding(F.try_divide(left, raw), 4).alias("retained"), F.count(F.lit(1)).alias("dates"))


# ---- pairs ---------------------------------------------------------------------------------------

FORMATION, REFRESH, MOST = 36, 12, 50
ROLLING = f"""di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM b)),
 fo AS (SELECT f AS fold, date FROM di, range(0, 1000) r(f) WHERE i >= f * {REFRESH} AND i < f * {REFRESH} + {FORMATION} AND f * {REFRESH} + {FORMATION} < n),
 ap AS (SELECT (i - {FORMATION}) // {REFRESH} AS fold, date FROM di WHERE i >= {FORMATION}),
 lg AS (SELECT fold, symbol, date, ln(close) AS p FROM b JOIN fo USING (date)), fl AS (SELECT fold, symbol FROM lg GROUP BY ALL HAVING count(*) = {FORMATION}), lf AS (SELECT lg.* FROM lg JOIN fl USING (fold, symbol)),
 pp AS (SELECT fold, x.symbol AS a, y.symbol AS b, date, x.p AS x, y.p AS y FROM lf x JOIN lf y USING (fold, date) WHERE x.symbol < y.symbol),
 hg AS (SELECT fold, a, b, sum(x * y) / sum(y * y) AS hedge FROM pp GROUP BY ALL), sp AS (SELECT fold, a, b, hedge, date, x - hedge * y AS s FROM pp JOIN hg USING (fold, a, b)),
 df AS (SELECT *, lag(s) OVER w AS s0, s - lag(s) OVER w AS ds FROM sp WINDOW w AS (PARTITION BY fold, a, b ORDER BY date)),
 rg AS (SELECT fold, a, b, any_value(hedge) AS hedge, avg(s) AS m, stddev_samp(s) AS sd, count(*) AS n, regr_sxx(ds, s0) AS sxx, regr_sxy(ds, s0) AS sxy, regr_syy(ds, s0) AS syy FROM df GROUP BY fold, a, b),
 pt AS (SELECT fold, a, b, hedge, m, sd, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / ((n - 3) * sxx)) AS t FROM rg),
 np AS (SELECT * FROM pt WHERE sd > 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY floor(t * 1e6 + 0.5), a, b) <= {MOST}),
 ln AS (SELECT fold, symbol, date, ln(close) AS p FROM b JOIN ap USING (date)),
 zz AS (SELECT x.date, np.a, np.b, (x.p - hedge * y.p - m) / sd AS z FROM np JOIN ln x ON x.fold = np.fold AND x.symbol = np.a JOIN ln y ON y.fold = np.fold AND y.symbol = np.b AND y.date = x.date),
 ch AS (SELECT date, symbol, avg(c) AS cheapness, count(*) AS pairs FROM (SELECT date, a AS symbol, -z AS c FROM zz UNION ALL SELECT date, b, z FROM zz) GROUP BY ALL)"""


@query("M4_rolling_cheapness", sql(bars_sql("month"), ROLLING, select="SELECT date, symbol, round(cheapness, 5) AS cheapness, pairs FROM ch"))
def m4(spark, sf):
    """Pairs selected anew each year on the three years before; the 50 nearest of a fold, whatever their p-values, as SQL has none."""
    b = files.written(bars(spark, sf, "month").select("symbol", "date", "close"), "monthly-bars")  # folds, their dates and both legs read them
    d = studies.rolling_pair_scores(b, formation=FORMATION, refresh=REFRESH, level=None, most=MOST)
    return d.select("date", "symbol", rounding("cheapness", 5).alias("cheapness"), "pairs")


# ---- boosting ------------------------------------------------------------------------------------

INPUTS = ("momentum", "reversal", "volatility", "size", "volume_ratio")


def training_panel(spark, sf) -> DataFrame:
    """date, symbol, role, five features, the forward return, its rank as target and its place."""
    b = features.with_volatility(bars(spark, sf), 26, 52)
    b = b.withColumns({"momentum": features.momentum(26, 4), "reversal": features.change("close", 4, lag=1), "volatility": F.col("realized_vol_26"), "size": F.log(F.col("close") * F.col("volume")), "volume_ratio": features.FEATURES["volume_ratio_20"](), "forward_return": features.forward_return(1)})
    b = b.dropna(subset=[*INPUTS, "forward_return"]).where("abs(forward_return) <= 5")
    rows = metrics.placed(boosting.rank_label(b.select("date", "symbol", *INPUTS, "forward_return")), "forward_return")  # the target's place is the return's
    return market.chronological_split(files.written(rows, "panel"))  # the split reads its dates too


@query("M9_rank_ic_boosting")
def m9(spark, sf):
    """Per round: the training dates' mean correlation, the validation dates' mean rank IC, and whether the round is kept. No SQL: it has no trees; a test holds the loop against a plain one."""
    model = boosting.rank_ic_boosted(training_panel(spark, sf), INPUTS, rounds=8, patience=5)
    d = boosting.training_report(model, spark)
    return d.select("round", rounding("train_objective", 6).alias("train_objective"), rounding("validation_ic", 6).alias("validation_ic"), "kept")


# ---- calibration ---------------------------------------------------------------------------------


@query("M5_calibrated_out_of_sample")
def m5(spark, sf):
    """Win rates by score learned on the training dates and read at every later row. No SQL: a test holds the fit against a plain loop."""
    d = market.chronological_split(scored(spark, sf)).withColumn("outcome", (F.col("forward_return") > 0).cast("double"))
    fit = calibration.fitted(d.where("role = 'train'"))
    later = d.where("role <> 'train'")
    rows = fit.calibrated(later) if fit else later.withColumn("p", F.lit(None).cast("double"))
    return rows.select("date", "symbol", "role", rounding("p", 6).alias("p"), "outcome")


# ---- walk-forward and sweeps ---------------------------------------------------------------------


@query("M10_walk_forward")
def m10(spark, sf):
    """Predictions of every test block by a model of the dates before it, with its fold's measures. No SQL: it has no trees."""
    p = files.written(training.walk_forward(training_panel(spark, sf), INPUTS, [{"maxIter": 5, "maxDepth": 3}], folds=4, embargo=2), "predictions")
    m = training.measured(p, "fold").select("fold", *(rounding(c, 6).alias(c) for c in ("mse", "direction", "mean_ic", "icir", "t")))
    return p.join(F.broadcast(m), "fold").select("fold", "date", "symbol", rounding("p", 6).alias("p"), rounding("target", 6).alias("actual"), "mse", "direction", "mean_ic", "icir", "t")  # a fold is a row


@query("M11_sweep")
def m11(spark, sf):
    """Settings of the trees over folds of one panel, ranked by mean IC. No SQL: it has no trees."""
    settings = [{"maxIter": n, "maxDepth": d, "stepSize": r} for n, d, r in ((2, 2, 0.1), (4, 2, 0.3), (4, 3, 0.1), (4, 4, 0.1))]
    p = files.written(training.walk_forward(training_panel(spark, sf), INPUTS, settings, folds=2, embargo=2), "predictions")
    named = spark.createDataFrame([(k, s["maxIter"], s["maxDepth"], s["stepSize"]) for k, s in enumerate(settings)], "setting int, rounds int, depth int, rate double")
    d = training.ranked(training.measured(p, "setting", "fold")).join(F.broadcast(named), "setting")
    return d.select("place", "setting", "rounds", "depth", "rate", "folds", *(rounding(c, 6).alias(c) for c in ("mean_ic", "worst_ic", "mse")))


# ---- boosted trees -------------------------------------------------------------------------------


def boosted(train: DataFrame, *, rounds: int = 10, depth: int = 3):
    """MLlib's boosted trees of the five inputs for the ranked return; the validation block stops them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    trees = GBTRegressor(featuresCol="x", labelCol="target", predictionCol="p", maxIter=rounds, maxDepth=depth, validationIndicatorCol="held", seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=list(INPUTS), outputCol="x"), trees]).fit(train.withColumn("held", F.col("role") == "validation"))


@query("M7_boosted_trees")
def m7(spark, sf):
    """Predictions of the test block. No SQL: it has no trees."""
    d = training_panel(spark, sf)
    rows = boosted(d.where("role <> 'test'")).transform(d.where("role = 'test'"))
    return rows.select("date", "symbol", rounding("p", 6).alias("p"), rounding("target", 6).alias("actual"))


@query("M8_permutation_importance")
def m8(spark, sf):
    """What squared error and mean rank IC on the validation block lose when a feature is dealt anew within its dates, in two draws each. No SQL: it has no trees."""
    d = training_panel(spark, sf)
    model, held = boosted(d.where("role <> 'test'"), rounds=5), d.where("role = 'validation'")
    draws = [("", 0, held), *((c, k, studies.shuffled(held, c, 11 + 2 * k)) for c in INPUTS for k in range(2))]
    every = None
    for feature, draw, rows in draws:
        one = model.transform(rows).select(F.lit(feature).alias("feature"), F.lit(draw).alias("draw"), "date", "symbol", "p", "target", "place")
        every = one if every is None else every.unionByName(one)
    m = training.measured(files.written(every, "draws"), "feature", "draw").select("feature", "draw", "mse", "mean_ic")
    plain = m.where("feature = ''").select(F.col("mse").alias("base"), F.col("mean_ic").alias("ic"))
    d = m.where("feature <> ''").crossJoin(F.broadcast(plain))  # one row
    return d.select("feature", "draw", rounding(F.col("mse") - F.col("base"), 9).alias("importance"), rounding(F.col("ic") - F.col("mean_ic"), 6).alias("ic_lost"))


@query(
    "G38_prediction_skill",
    sql(scored_sql(), PRED, ic_sql(source="pd", score="p"), nw_sql(lags=4), "er AS (SELECT avg(pow(p - won, 2)) AS mse, avg(CASE WHEN sign(score) = sign(forward_return) THEN 1.0 ELSE 0.0 END) AS direction FROM pd)", select=f"SELECT {SUMMARY}, round(mse, 6) AS mse, round(direction, 6) AS direction FROM nw, er"),
)
def g38(spark, sf):
    """Rank IC of predictions with its Newey-West t, beside their squared error and share of right signs."""
    d = predictions(spark, sf)
    error = d.agg(F.avg(F.pow(F.col("p") - F.col("won"), 2)).alias("mse"), F.avg((F.signum("score") == F.signum("forward_return")).cast("double")).alias("direction"))
    return out(metrics.ic_summary(metrics.rank_ic(d, score="p"), 4).crossJoin(F.broadcast(error)))  # one row each


# ---- features by name ----------------------------------------------------------------------------

ASKED = ("sma_20", "return_5d", "atr_14", "relative_price", "excess_return_1", "reversal_rank", "value_share")
PLANNED = f"""ra AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, lag(close) OVER w AS c1, lag(volume) OVER w AS v1, lag(close) OVER w / lag(close, 2) OVER w - 1 AS r1, lag(close) OVER w / lag(close, 5) OVER w - 1 AS r4, lag(close) OVER w / lag(close, 6) OVER w - 1 AS return_5d FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
 fe AS (SELECT *, {frame('avg($)', 'close', 20)} AS sma_20, {frame('avg($)', 'tr', 14)} AS atr_14 FROM ra),
 pl AS (SELECT symbol, date, sma_20, return_5d, atr_14, c1 / avg(c1) OVER d AS relative_price, r1 - avg(r1) OVER d AS excess_return_1, c1 * v1 / sum(c1 * v1) OVER d AS value_share,
  CASE WHEN r4 IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY r4 DESC NULLS LAST) + (count(*) OVER (PARTITION BY date, r4) - 1) / 2.0) / (count(r4) OVER d + 1) END AS reversal_rank FROM fe WINDOW d AS (PARTITION BY date))"""


def bar_store(spark, sf) -> DataFrame:
    """The weekly bars as a bucketed table in the shared folder."""
    path = files.scratch(spark, "bar_store")
    return store_bars(bars(spark, sf), path.rsplit("/", 1)[1].replace("-", "_"), buckets=8, path=path)


@query("W23_planned_features", sql(bars_sql(), PLANNED, select="SELECT symbol, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ASKED) + " FROM pl"))
def planned_features(spark, sf):
    return out(planner.planned(bar_store(spark, sf), ASKED))


@query("A13_bar_store", sql(bars_sql(), "x AS (SELECT symbol, date, close, lag(close) OVER w AS before, lead(close) OVER w AS after FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date))", select="SELECT symbol, count(*) AS bars, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (WHERE close > before AND close > after) AS peaks FROM x GROUP BY symbol"))
def a13(spark, sf):
    """Bars, span and local peaks of each symbol, from the store: neither the window nor the aggregate shuffles."""
    w = Window.partitionBy("symbol").orderBy("date")
    d = bar_store(spark, sf).withColumns({"before": F.lag("close").over(w), "after": F.lead("close").over(w)})
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if((F.col("close") > F.col("before")) & (F.col("close") > F.col("after"))).alias("peaks"))
