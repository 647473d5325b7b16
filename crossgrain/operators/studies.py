"""Studies over trials, pairs and recommendations: overfitting, deflated ratios, pair scores, gradients, tables to act on."""

from __future__ import annotations

from itertools import combinations
from math import e

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.expressions import normal_cdf, risk_quantity
from crossgrain.functions.frames import across
from crossgrain.operators import market
from crossgrain.operators.grouped import normal_quantile

EULER = 0.5772156649015329


def strided_rows(sessions: int, stride: int, least: int = 20) -> int:
    """The rows of a window of ``sessions`` where only every ``stride``-th is kept."""
    return max(least, sessions // stride)


def seeded_symbols(symbols: DataFrame, most: int, *, seed: int, purpose: str) -> DataFrame:
    """The ``most`` symbols that come first in an order of the seed's and the purpose's own."""
    draw = F.xxhash64("symbol", F.lit(seed), F.crc32(F.lit(purpose).cast("binary")))
    return symbols.select("symbol").distinct().orderBy(draw, "symbol").limit(most)


# ---- trials --------------------------------------------------------------------------------------


def halves(blocks: int) -> list[tuple[int, int]]:
    """(split, block) of the blocks on the near side of every way to halve them."""
    return [(k, b) for k, side in enumerate(combinations(range(blocks), blocks // 2)) for b in side]


def overfitting(returns: DataFrame, *, blocks: int = 6) -> DataFrame:
    """(split, best, rank, logit): for every way to halve the blocks of dates, the trial that is best on the near side and its rank on the far side.

    ``returns`` is (trial, date, r). A trial is three sums for each block, which is all that the splits are joined to. A logit of 0 or less says
    that the best was no better than the middle; the share of such splits is the probability of overfitting.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    dates = returns.select("date").distinct().withColumn("block", F.floor((F.row_number().over(w) - 1) * blocks / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).cast("int"))
    sums = returns.join(F.broadcast(dates), "date").groupBy("trial", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    spark = returns.sparkSession
    sides = spark.createDataFrame(halves(blocks), "split int, block int").withColumn("near", F.lit(True))
    every = sides.select("split").distinct().crossJoin(spark.range(blocks).select(F.col("id").cast("int").alias("block"))).join(sides, ["split", "block"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    d = sums.join(F.broadcast(every), "block").groupBy("split", "near", "trial").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt((F.col("ss") - F.col("s") * mean) / (F.col("n") - 1))
    d = d.withColumn("ratio", F.try_divide(mean, sd))
    d = d.groupBy("split", "trial").agg(F.max(F.when(F.col("near"), F.col("ratio"))).alias("near"), F.max(F.when(~F.col("near"), F.col("ratio"))).alias("far")).where("near is not null and far is not null")
    best = d.groupBy("split").agg(F.max_by(F.struct("trial", "far"), F.struct("near", "trial")).alias("b"), F.count(F.lit(1)).alias("trials"))
    d = d.join(best, "split").groupBy("split", "b", "trials").agg(F.count_if(F.col("far") <= F.col("b.far")).alias("rank"))
    place = F.col("rank") / (F.col("trials") + 1)
    return d.select("split", F.col("b.trial").alias("best"), "rank", F.log(place / (1 - place)).alias("logit"))


def expected_best(variance: Column, trials: Column) -> Column:
    """The Sharpe ratio that the best of so many trials without skill is expected to show (Bailey and Lopez de Prado, 2014)."""
    return F.when(trials > 1, F.sqrt(variance) * ((1 - EULER) * normal_quantile(1 - 1 / trials) + EULER * normal_quantile(1 - 1 / (trials * e)))).otherwise(0.0)


def deflated(trials: DataFrame) -> DataFrame:
    """Adds ``sharpe``, ``expected_best``, ``psr`` (against 0) and ``dsr`` (against the expected best) to moments (n, mean, sd, skew, kurtosis) of trials."""
    w = Window.partitionBy(F.lit(0))  # one row a trial
    d = trials.withColumn("sharpe", F.try_divide("mean", "sd"))
    d = d.withColumn("expected_best", expected_best(F.var_samp("sharpe").over(w), F.count("sharpe").over(w)))
    s = F.col("sharpe")
    spread = F.sqrt(F.greatest(1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s, F.lit(1e-12)) / (F.col("n") - 1))
    return d.withColumns({"psr": normal_cdf(s / spread), "dsr": normal_cdf((s - F.col("expected_best")) / spread)})


# ---- pairs ---------------------------------------------------------------------------------------


def nearest_pairs(tests: DataFrame, most: int = 50) -> DataFrame:
    """The pairs of the smallest statistics whose spread moves."""
    return tests.where("t is not null and spread_std > 0").withColumn("_t", F.floor(F.col("t") * 1e6 + 0.5)).orderBy("_t", "a", "b").limit(most).drop("_t")


def pair_scores(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(date, symbol, cheapness, pairs): how far a symbol lies below its pairs' spreads, in deviations, on average over its pairs."""
    logs = prices.where("close > 0").select("date", "symbol", F.log("close").alias("p"))
    a, b = logs.select("date", F.col("symbol").alias("a"), F.col("p").alias("pa")), logs.select("date", F.col("symbol").alias("b"), F.col("p").alias("pb"))
    known = F.broadcast(pairs.select("a", "b", "hedge", "spread_mean", "spread_std"))  # at most as many as were selected
    d = a.join(known, "a").join(b, ["date", "b"]).withColumn("z", (F.col("pa") - F.col("hedge") * F.col("pb") - F.col("spread_mean")) / F.col("spread_std"))
    legs = d.select("date", F.explode(F.array(F.struct(F.col("a").alias("symbol"), (-F.col("z")).alias("c")), F.struct(F.col("b").alias("symbol"), F.col("z").alias("c")))).alias("l"))
    return legs.groupBy("date", "l.symbol").agg(F.avg("l.c").alias("cheapness"), F.count(F.lit(1)).alias("pairs"))


def formation_folds(prices: DataFrame, formation: int, refresh: int) -> tuple[DataFrame, DataFrame]:
    """``prices`` twice, with ``fold``: the sessions each fold is formed on, and those it is applied to.

    Sessions are the panel's dates. Fold k is formed on ``formation`` sessions from number k * ``refresh`` on and applied to the
    ``refresh`` sessions right after them, so nothing applied to a date was formed with it or a later one.
    """
    if refresh < 1 or formation < 1:
        raise ValueError("formation and refresh are at least one session")
    w = Window.partitionBy(F.lit(0))  # one row a date
    dates = prices.select("date").distinct().withColumns({"_i": F.row_number().over(w.orderBy("date")) - 1, "_all": F.count(F.lit(1)).over(w)})
    last = F.floor((F.col("_all") - 1 - formation) / refresh)  # the last fold that is applied to a session
    first, to = F.greatest(F.lit(0), F.floor((F.col("_i") - formation) / refresh) + 1), F.least(last, F.floor(F.col("_i") / refresh))
    formed = dates.where(to >= first).select("date", F.explode(F.sequence(first.cast("long"), to.cast("long"))).alias("fold"))
    applied = dates.where(F.col("_i") >= formation).select("date", F.floor((F.col("_i") - formation) / refresh).cast("long").alias("fold"))
    return prices.join(F.broadcast(formed), "date"), prices.join(F.broadcast(applied), "date")  # rows a date: formation / refresh


def rolling_pair_scores(prices: DataFrame, *, formation: int = 252, refresh: int = 63, level: float | None = 0.05, most: int = 50) -> DataFrame:
    """(date, symbol, cheapness, pairs) with pairs selected anew every ``refresh`` sessions on the ``formation`` sessions before.

    A fold keeps its ``most`` pairs of the smallest statistics, and of those only pairs whose p-value is within ``level`` over the
    number of pairs it tested (all, where ``level`` is None). Dates before the first fold and symbols of no pair have no row.
    """
    formed, applied = formation_folds(prices, formation, refresh)
    tests = market.pair_tests(formed, nearest=most if level is None else None)
    fold = Window.partitionBy("fold")
    d = tests.withColumn("_tested", F.count(F.lit(1)).over(fold)).where("t is not null and spread_std > 0")
    if level is not None:
        d = d.where(F.col("p_value") <= level / F.col("_tested"))
    d = d.withColumn("_rank", F.row_number().over(fold.orderBy(F.floor(F.col("t") * 1e6 + 0.5), "a", "b"))).where(F.col("_rank") <= most)
    known = d.select("fold", "a", "b", "hedge", "spread_mean", "spread_std")
    logs = applied.where("close > 0").select("fold", "date", "symbol", F.log("close").alias("p"))
    a, b = (logs.select("fold", "date", F.col("symbol").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
    d = a.join(known, ["fold", "a"]).join(b, ["fold", "date", "b"]).withColumn("z", (F.col("pa") - F.col("hedge") * F.col("pb") - F.col("spread_mean")) / F.col("spread_std"))
    legs = d.select("date", F.explode(F.array(F.struct(F.col("a").alias("symbol"), (-F.col("z")).alias("c")), F.struct(F.col("b").alias("symbol"), F.col("z").alias("c")))).alias("l"))
    return legs.groupBy("date", "l.symbol").agg(F.avg("l.c").alias("cheapness"), F.count(F.lit(1)).alias("pairs"))


# ---- models --------------------------------------------------------------------------------------


def ic_gradient(panel: DataFrame, *, score: str = "score", label: str = "forward_return") -> DataFrame:
    """Adds ``correlation`` of score and label over each date, and ``gradient``: how it grows with each score. Null where either does not vary."""
    w = across("date")
    n = F.count(F.lit(1)).over(w)
    p, y = F.col(score) - F.avg(score).over(w), F.col(label) - F.avg(label).over(w)
    lp, ly = F.sqrt(F.var_pop(score).over(w) * n), F.sqrt(F.var_pop(label).over(w) * n)
    d = panel.withColumns({"_p": F.try_divide(p, lp), "_y": F.try_divide(y, ly), "_l": lp})
    d = d.withColumn("correlation", F.sum(F.col("_p") * F.col("_y")).over(w))
    return d.withColumn("gradient", (F.col("_y") - F.col("correlation") * F.col("_p")) / F.col("_l")).drop("_p", "_y", "_l")


def shuffled(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """``rows`` with the values of ``column`` dealt anew within each date: both are numbered in seeded orders and matched by number."""
    own = Window.partitionBy("date").orderBy(F.xxhash64("symbol", F.lit(seed)), "symbol")
    other = Window.partitionBy("date").orderBy(F.xxhash64("symbol", F.lit(seed + 1)), "symbol")
    left = rows.withColumn("_n", F.row_number().over(own)).drop(column)
    right = rows.select("date", column, F.row_number().over(other).alias("_n"))
    return left.join(right, ["date", "_n"]).drop("_n").select(*rows.columns)


# ---- tables to act on ----------------------------------------------------------------------------


def recommendations(signals: DataFrame, *, equity: float, risk: float = 0.01, position: float = 0.1, sector: float = 0.25, least_price: float = 10.0, most: float | None = None) -> DataFrame:
    """Signals (date, symbol, sector, signal, score, entry, stop, position_scale) to buy with quantity, investment, largest loss and compliance, best first.

    A sector's names are filled in order of score until what they ask for comes to ``sector`` of equity; a quantity is cut to the room that is left.
    A position worth more than ``most`` of equity (``position`` where that is None) does not comply.
    """
    d = signals.where("signal = 'BUY'").withColumn("wanted", F.floor(risk_quantity(F.lit(equity), F.col("entry"), F.col("stop"), risk, position) * F.col("position_scale")).cast("long"))
    order = Window.partitionBy("date", "sector").orderBy(F.desc("score"), "symbol").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("wanted") * F.col("entry")).over(order), F.lit(0.0))
    room = F.floor(F.greatest(F.lit(0.0), sector * equity - before) / F.col("entry")).cast("long")
    d = d.withColumn("quantity", F.least("wanted", room))
    money = F.col("quantity") * F.col("entry")
    status = F.when(F.col("entry") < least_price, "price").when(F.col("quantity") <= 0, "quantity").when(money > (position if most is None else most) * equity, "position").otherwise("passed")
    return d.select("date", "symbol", "sector", "score", "quantity", money.alias("investment"), (F.col("quantity") * (F.col("entry") - F.col("stop"))).alias("max_loss"), status.alias("compliance")).orderBy(F.desc("score"), "date", "symbol")


def caveats(runs: DataFrame) -> DataFrame:
    """Adds ``codes`` to runs (gross, net, rebalances, up_ic, down_ic, members, fundamentals): what a reader has to know of each."""
    codes = {
        "survivorship": ~F.col("members"), "no_fundamentals": ~F.col("fundamentals"), "no_rebalances": F.col("rebalances") == 0,
        "cost_not_survived": (F.col("gross") > 0) & (F.col("net") <= 0), "state_dependent": F.col("up_ic") * F.col("down_ic") < 0,
    }
    return runs.withColumn("codes", F.array_join(F.array_compact(F.array(*[F.when(when, name) for name, when in codes.items()])), ","))


def book_risks(covariances: DataFrame) -> DataFrame:
    """(date, names, volatility) of the equal-weight book of ``covariances(date, i, j, cov)`` for i <= j."""
    own = F.col("i") == F.col("j")
    d = covariances.groupBy("date").agg(F.count_if(own).alias("names"), F.sum(F.when(own, F.col("cov")).otherwise(2 * F.col("cov"))).alias("s"))
    return d.select("date", "names", (F.sqrt(F.greatest("s", F.lit(0.0))) / F.col("names")).alias("volatility"))
