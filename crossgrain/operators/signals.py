"""Rankings into signals, rule-based scores, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions import expressions as X
from crossgrain.functions.frames import across, average_rank, rounding

#: Screens of tradability, in order; fixed values.
LEAST_TRADED_VALUE = 5_000_000.0
MOST_ZERO_RETURNS = 0.30
MOST_LOCKED = 0.10
MOST_TRAPPED = 0.05


def reject_reason() -> Column:
    """The first screen that a row fails; what is unknown passes."""
    out = F.when(F.col("traded_value") < LEAST_TRADED_VALUE, "traded_value").when(F.col("zero_return_share") > MOST_ZERO_RETURNS, "zero_return")
    out = out.when(F.col("locked_share") > MOST_LOCKED, "locked").when(F.col("trapped_share") > MOST_TRAPPED, "operator_trap")
    return out.when(F.col("locked_last"), "locked_today").when(F.col("trapped_last"), "trapped_today")


def rank_and_select(panel: DataFrame, *, top: float = 0.1, high_is_good: bool = True, min_universe: int = 30, k_stop: float = 1.5, k_target: float = 2.0, min_price: float = 10.0, volatility_target: float = 0.15, buy: float | None = None, sell: float | None = None) -> DataFrame:
    """Signals of all dates at once: BUY, WATCH or AVOID with score, levels and position scale.

    ``panel`` has date, symbol, metric, close, atr, volatility, reject_reason and, per date,
    exposure and blocked. Rejected rows and dates of few names are AVOID.
    """
    buy = X.cost_per_side("BUY") if buy is None else buy
    sell = X.cost_per_side("SELL") if sell is None else sell
    fit = F.col("reject_reason").isNull() & F.col("metric").isNotNull()
    order = F.desc("metric") if high_is_good else F.asc("metric")
    w = Window.partitionBy("date", "fit")
    d = panel.withColumn("fit", fit).withColumns({"n": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy(order, "symbol"))})
    ranked = F.col("fit") & (F.col("n") >= min_universe)
    stop, target = X.stop_and_target(F.col("close"), F.col("atr"), k_stop, k_target)
    d = d.withColumns({"stop": stop, "target": target})
    valid = F.col("stop") < F.col("close")
    rr = F.when(valid, X.net_reward_risk(F.col("close"), F.col("stop"), F.col("target"), buy, sell)).otherwise(0.0)
    scale = rounding(F.greatest(F.col("exposure") * X.volatility_scalar(F.col("volatility"), volatility_target), F.lit(0.0)), 4)
    in_top = F.col("rank") <= F.greatest(F.ceil(F.col("n") * top), F.lit(1))
    score = rounding((1 - F.when(F.col("n") > 1, (F.col("rank") - 1) / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(0.0)) * 100, 2)
    signal = F.when(~ranked | ~valid, "AVOID").when(in_top & (F.col("close") >= min_price) & (rr > 0) & ~F.col("blocked"), "BUY").when(in_top, "WATCH").otherwise("AVOID")
    d = d.withColumn("signal", signal)
    zero = lambda x: F.when(ranked, x).otherwise(0.0)
    return d.select("date", "symbol", "metric", "signal", zero(score).alias("score"), F.col("close").alias("entry"), zero(F.col("stop")).alias("stop"), zero(F.col("target")).alias("target"), zero(rounding(rr, 4)).alias("reward_risk"), F.when(F.col("signal") == "BUY", scale).otherwise(0.0).alias("position_scale"), "reject_reason")


#: Weights of the rule-based components and their trigger order; fixed values.
WEIGHTS = {"trend": 40.0, "breakout": 30.0, "volume": 15.0, "probability": 15.0}


def rule_components() -> dict[str, Column]:
    """trend 0, ½ or 1; breakout 0 or 1; volume up to 1; probability as it comes."""
    trend = F.when((F.col("close") > F.col("sma_fast")) & (F.col("sma_fast") > F.col("sma_slow")), 1.0).when(F.col("close") > F.col("sma_slow"), 0.5).otherwise(0.0)
    return {
        "trend": F.when(F.col("sma_fast").isNotNull() & F.col("sma_slow").isNotNull(), trend),
        "breakout": F.when(F.col("upper").isNotNull(), F.when(F.col("close") > F.col("upper"), 1.0).otherwise(0.0)),
        "volume": F.when(F.col("volume_ratio").isNotNull(), F.least(F.greatest(F.col("volume_ratio") / 2, F.lit(0.0)), F.lit(1.0))),
        "probability": F.col("probability"),
    }


def weighted(components: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the components there are, from 0 to 100."""
    have = [(F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0), F.coalesce(c, F.lit(0.0))) for k, c in components.items()]
    total, mass = sum((w * c for w, c in have), F.lit(0.0)), sum((w for w, _ in have), F.lit(0.0))
    return F.when(mass > 0, 100 * total / F.when(mass > 0, mass)).otherwise(0.0)


def rule_based(rows: DataFrame, *, buy_from: float = 60.0, watch_from: float = 45.0, least_probability: float = 0.55, min_price: float = 10.0, min_reward_risk: float = 1.0, buy: float | None = None, sell: float | None = None) -> DataFrame:
    """Adds component columns, score, trigger and signal; without a probability nothing is bought."""
    buy = X.cost_per_side("BUY") if buy is None else buy
    sell = X.cost_per_side("SELL") if sell is None else sell
    parts = rule_components()
    d = rows.withColumns({f"c_{k}": c for k, c in parts.items()})
    cols = {k: F.col(f"c_{k}") for k in parts}
    stop, target = X.stop_and_target(F.col("close"), F.col("atr"), 1.5, 2.0)
    d = d.withColumns({"score": rounding(weighted(cols), 2), "stop": stop, "target": target})
    d = d.withColumn("reward_risk", X.net_reward_risk(F.col("close"), F.col("stop"), F.col("target"), buy, sell))
    trigger = F.when(cols["breakout"] >= 1, "Breakout").when(cols["trend"] >= 1, "Trend").when(cols["volume"] >= 0.75, "Volume").when(cols["probability"] >= least_probability, "Probability").otherwise("None")
    good = (F.col("score") >= buy_from) & (F.coalesce(F.col("probability"), F.lit(0.0)) >= least_probability) & (F.col("reward_risk") >= min_reward_risk) & (F.col("close") >= min_price)
    return d.withColumns({"trigger": trigger, "signal": F.when(good, "BUY").when(F.col("score") >= watch_from, "WATCH").otherwise("AVOID")})


def rank_components(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``r_<column>``: the rank's share among the date's rows that have a value."""
    out = {}
    for c in columns:
        have = F.col(c).isNotNull()
        key = F.when(have, F.lit(1)).otherwise(0)
        rank = F.rank().over(Window.partitionBy("date", key).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("date", key, c)) - 1) / 2
        out[f"r_{c}"] = F.when(have, rank / F.count(F.col(c)).over(across("date")))
    return rows.withColumns(out)


def in_sector_order(signals: DataFrame, allowance: float) -> DataFrame:
    """Sells first by symbol, buys by score; a buy takes what its sector has left, in that order."""
    w = Window.partitionBy("date", "sector").orderBy(F.desc("score"), "symbol")
    d = signals.withColumn("_before", F.coalesce(F.sum(F.when(F.col("signal") == "BUY", F.col("value"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    taken = F.when(F.col("signal") == "BUY", F.least(F.col("value"), F.greatest(F.lit(allowance) - F.col("_before"), F.lit(0.0)))).otherwise(F.col("value"))
    order = Window.partitionBy("date").orderBy(F.when(F.col("signal") == "SELL", 0).otherwise(1), F.when(F.col("signal") == "SELL", F.lit(0.0)).otherwise(-F.col("score")), "symbol")
    return d.withColumns({"taken": taken, "place": F.row_number().over(order)}).drop("_before")


# ---- ensembles -----------------------------------------------------------------------------------

#: What a signal counts in a blend; fixed values.
STRENGTH = {"BUY": 1.0, "WATCH": 0.3, "HOLD": 0.0, "AVOID": -0.3, "SELL": -1.0}


def strength(signal: Column) -> Column:
    out = F.when(signal == "BUY", STRENGTH["BUY"])
    for k in ("WATCH", "HOLD", "AVOID", "SELL"):
        out = out.when(signal == k, STRENGTH[k])
    return out.otherwise(0.0)


def blended(votes: DataFrame) -> DataFrame:
    """(date, symbol, strength, signal) from rows (date, symbol, model, signal, weight)."""
    d = votes.groupBy("date", "symbol").agg(F.try_divide(F.sum(strength(F.col("signal")) * F.col("weight")), F.sum("weight")).alias("strength"))
    return d.withColumn("signal", F.when(F.col("strength") >= 0.6, "BUY").when(F.col("strength") >= 0.2, "WATCH").when(F.col("strength") <= -0.6, "SELL").otherwise("AVOID"))


def voted(votes: DataFrame, *, unanimous: bool = False) -> DataFrame:
    """BUY where most (or all) models buy; WATCH where any does."""
    d = votes.groupBy("date", "symbol").agg(F.count_if(F.col("signal") == "BUY").alias("buys"), F.count(F.lit(1)).alias("models"))
    enough = F.col("buys") == F.col("models") if unanimous else F.col("buys") * 2 > F.col("models")
    return d.withColumn("signal", F.when(enough, "BUY").when(F.col("buys") > 0, "WATCH").otherwise("AVOID"))


def permitted(votes: DataFrame, regimes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Votes of the models that the date's regime permits; a regime without a list permits all."""
    d = votes.join(regimes.select("date", "regime"), "date", "left")
    listed = F.broadcast(allowed.select("regime").distinct().withColumn("_listed", F.lit(True)))  # one row per regime
    own = F.broadcast(allowed.withColumn("_own", F.lit(True)))
    return d.join(listed, "regime", "left").join(own, ["regime", "model"], "left").where(F.col("_listed").isNull() | F.col("_own")).drop("_listed", "_own")


def arbitrated(verdicts: DataFrame, *, strong_from: float = 0.8, consensus: int = 2, least_ev: float = 0.0) -> DataFrame:
    """One decision per date and symbol from model verdicts, by vetoes in order and then strength or consensus."""
    buy, sell = F.col("action") == "BUY", F.col("action").isin("SELL", "AVOID")
    d = verdicts.groupBy("date", "symbol").agg(
        F.count_if(buy & F.col("regime_compatible")).alias("buys"),
        F.count_if(sell).alias("against"),
        F.bool_and("liquidity_pass").alias("liquid"),
        F.bool_or("regime_compatible").alias("fits"),
        F.max(F.when(buy, F.col("confidence"))).alias("best"),
        F.try_divide(F.sum(F.when(buy, F.col("confidence") * F.col("ev"))), F.sum(F.when(buy, F.col("confidence")))).alias("ev"),
        F.array_sort(F.collect_list(F.when(buy, F.col("model")))).alias("backers"),
    )
    reason = F.when(~F.col("liquid"), "liquidity").when(~F.col("fits"), "regime").when(F.col("buys") == 0, "no_buys").when(F.col("against") >= F.col("buys"), "conflict").when(F.col("ev") <= least_ev, "expected_value")
    reason = reason.when(F.col("best") >= strong_from, "strong").when(F.col("buys") >= consensus, "consensus").otherwise("weak")
    size = F.when(reason == "strong", F.least(F.lit(1.0), F.col("best"))).when(reason == "consensus", F.least(F.lit(1.0), F.col("buys") / (F.col("buys") + F.col("against") + 1))).otherwise(0.0)
    return d.withColumns({"reason": reason, "fires": reason.isin("strong", "consensus"), "size": size})
