"""Books of weights (date, symbol, weight), equity curves (book_id, date, value) and trade logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.frames import across
from crossgrain.operators import gram
from crossgrain.operators.metrics import bucketed


def equal_weights(panel: DataFrame, buckets: int) -> DataFrame:
    """The top bucket, every name alike."""
    top = bucketed(panel, buckets).where(F.col("bucket") == buckets - 1)
    return top.select("date", "symbol", (1 / F.count(F.lit(1)).over(across("date"))).alias("weight"), "forward_return")


def inverse_volatility_weights(panel: DataFrame, buckets: int) -> DataFrame:
    """The top bucket by one over ``volatility``; names without one weigh 0, and dates of fewer than two weigh all alike."""
    top = bucketed(panel, buckets).where(F.col("bucket") == buckets - 1)
    inverse = F.when(F.col("volatility") > 0, 1 / F.when(F.col("volatility") > 0, F.col("volatility")))
    w = across("date")
    d = top.withColumns({"_i": inverse, "_n": F.count(inverse).over(w), "_all": F.count(F.lit(1)).over(w)})
    weight = F.when(F.col("_n") < 2, 1 / F.col("_all")).otherwise(F.coalesce(F.col("_i") / F.sum("_i").over(w), F.lit(0.0)))
    return d.select("date", "symbol", weight.alias("weight"), "forward_return")


def weight_turnover(weights: DataFrame) -> DataFrame:
    """(date, turnover): half the sum of weight changes; the first date comes from nothing."""
    dates = weights.select("date").distinct().withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    now = weights.join(F.broadcast(dates), "date").select("symbol", "r", "weight")
    was = now.select("symbol", (F.col("r") + 1).alias("r"), F.col("weight").alias("before"))
    d = now.join(was, ["symbol", "r"], "full").groupBy("r").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))) / 2).alias("turnover"))
    return d.join(F.broadcast(dates), "r").select("date", "turnover")


def book_returns(weights: DataFrame, round_trip: float) -> DataFrame:
    """(date, gross, turnover, net, names, max_weight)."""
    daily = weights.groupBy("date").agg(F.sum(F.col("weight") * F.col("forward_return")).alias("gross"), F.count_if(F.col("weight") > 0).alias("names"), F.max("weight").alias("max_weight"))
    return daily.join(weight_turnover(weights), "date").withColumn("net", F.col("gross") - F.col("turnover") * round_trip)


def compounded(returns: DataFrame, column: str = "net") -> DataFrame:
    """(date, equity): running product of 1 + r; a return of -1 or less ends at 0."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(column)
    grown = F.exp(F.sum(F.when(r > -1, F.log1p(F.when(r > -1, r)))).over(w))
    return returns.select("date", F.when(F.max((r <= -1).cast("int")).over(w) == 1, 0.0).otherwise(grown).alias("equity"))


def book_summary(daily: DataFrame, periods: float) -> DataFrame:
    """One row: mean gross, net, turnover, drag, annual return, volatility, Sharpe ratio, names and largest weight."""
    d = daily.agg(F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"), F.avg("turnover").alias("mean_turnover"), F.stddev_samp("net").alias("sd"), F.avg("names").alias("names"), F.max("max_weight").alias("max_weight"), F.count(F.lit(1)).alias("periods"))
    return d.select("mean_gross", "mean_net", "mean_turnover", (F.col("mean_gross") - F.col("mean_net")).alias("drag"), (F.col("mean_net") * periods).alias("annual_return"), (F.col("sd") * periods**0.5).alias("annual_volatility"), F.try_divide(F.col("mean_net") * periods**0.5, F.col("sd")).alias("sharpe"), "names", "max_weight", "periods")


# ---- equity curves -------------------------------------------------------------------------------


def underwater(curves: DataFrame) -> DataFrame:
    """(book_id, date, value, peak, drawdown)."""
    w = Window.partitionBy("book_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return curves.withColumn("peak", F.max("value").over(w)).withColumn("drawdown", F.try_divide(F.col("value"), F.col("peak")) - 1)


def drawdown_duration(curves: DataFrame) -> DataFrame:
    """(book_id, trough, depth, peak_date, recovery, days): from the last peak before the trough to the first recovery, or the end."""
    u = underwater(curves)
    low = u.groupBy("book_id").agg(F.min_by(F.struct(F.col("date").alias("trough"), "drawdown", "peak"), F.struct("drawdown", "date")).alias("t"), F.max("date").alias("end")).select("book_id", "t.*", "end").withColumnsRenamed({"peak": "high", "drawdown": "depth"})
    d = u.drop("peak", "drawdown").join(low, "book_id").groupBy("book_id", "trough", "depth", "end").agg(F.max(F.when((F.col("date") <= F.col("trough")) & (F.col("value") == F.col("high")), F.col("date"))).alias("peak_date"), F.min(F.when((F.col("date") > F.col("trough")) & (F.col("value") >= F.col("high")), F.col("date"))).alias("recovery"))
    return d.withColumn("days", F.date_diff(F.coalesce("recovery", "end"), "peak_date").cast("long")).drop("end")


def curve_metrics(curves: DataFrame, per_year: float, rate: float = 0.0) -> DataFrame:
    """Per book: total and annual growth, volatility, Sharpe, Sortino, drawdown and Calmar ratios."""
    w = Window.partitionBy("book_id").orderBy("date")
    r = F.try_divide(F.col("value"), F.lag("value").over(w)) - 1
    d = underwater(curves).withColumn("r", r).withColumn("x", F.col("r") - rate / per_year)
    g = d.groupBy("book_id").agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.count("r").alias("n"), F.stddev_samp("r").alias("sd"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sdx"), F.sqrt(F.avg(F.pow(F.least("x", F.lit(0.0)), 2))).alias("down"), F.min("drawdown").alias("max_drawdown"))
    cagr = F.pow(F.try_divide(F.col("last"), F.col("first")), F.try_divide(F.lit(float(per_year)), F.col("n"))) - 1
    return g.select("book_id", (F.try_divide(F.col("last"), F.col("first")) - 1).alias("total_return"), cagr.alias("cagr"), (F.col("sd") * per_year**0.5).alias("volatility"), (F.try_divide(F.col("mean"), F.col("sdx")) * per_year**0.5).alias("sharpe"), (F.try_divide(F.col("mean"), F.col("down")) * per_year**0.5).alias("sortino"), "max_drawdown", F.try_divide(cagr, F.abs("max_drawdown")).alias("calmar"))


def monthly_table(curves: DataFrame) -> DataFrame:
    """Month-end returns, a row per book and year, a column per month."""
    ends = curves.groupBy("book_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.max_by("value", "date").alias("v"))
    r = F.try_divide(F.col("v"), F.lag("v").over(Window.partitionBy("book_id").orderBy("year", "month"))) - 1
    d = ends.withColumn("r", r).groupBy("book_id", "year").pivot("month", list(range(1, 13))).agg(F.first("r"))
    return d.select("book_id", F.col("year").cast("long").alias("year"), *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def moments(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Population skewness and kurtosis (3 for a normal)."""
    return rows.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.skewness(column).alias("skew"), (F.kurtosis(column) + 3).alias("kurtosis"))


# ---- trades --------------------------------------------------------------------------------------


def first_touches(asked: DataFrame, bars: DataFrame, *, fanout: int = 64) -> DataFrame:
    """(key, exit_date, open, high, low) of the first bar from ``at`` on whose low is at or below ``stop`` or high at or above ``target``.

    ``asked`` has key, symbol, at (a place among the symbol's bars), stop and target; ``bars`` has symbol, at, date, open, high
    and low. A symbol's bars are an index of three levels: ``fanout`` bars to a block, ``fanout`` blocks to a group, with the
    lowest low and the highest high of each. A question climbs from its bar's block to its group and the symbol's groups, and
    descends again where a touch is: five equi-joins, each with one row for a question, however far away the touch is.
    """
    low, high = F.min("low").alias("low"), F.max("high").alias("high")
    listed = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    rows = bars.select("symbol", "at", "date", "open", "high", "low", F.floor(F.col("at") / fanout).alias("block"))
    leaves = rows.groupBy("symbol", "block").agg(listed("at", "date", "open", "high", "low").alias("inner"), low, high)
    blocks = leaves.select("symbol", "block", "low", "high", F.floor(F.col("block") / fanout).alias("group"))
    groups = blocks.groupBy("symbol", "group").agg(listed(F.col("block").alias("at"), "high", "low").alias("inner"), low, high)
    symbols = groups.groupBy("symbol").agg(listed(F.col("group").alias("at"), "high", "low").alias("inner"))
    leaves, groups = leaves.select("symbol", "block", "inner"), groups.select("symbol", "group", "inner")

    def first(after: Column) -> Column:
        """The first entry of ``inner`` from ``after`` on that touches."""
        touch = lambda x: (x["at"] >= after) & (F.coalesce(x["low"] <= F.col("stop"), F.lit(False)) | F.coalesce(x["high"] >= F.col("target"), F.lit(False)))
        return F.try_element_at(F.filter("inner", touch), F.lit(1))

    def step(d: DataFrame, level: DataFrame, keys: list[str], after: Column, name: str) -> DataFrame:
        return d.join(level, keys, "left").withColumn(name, first(after)).drop("inner")

    block = F.floor(F.col("at") / fanout)
    d = step(asked.withColumn("block", block), leaves, ["symbol", "block"], F.col("at"), "near")
    d = step(d.withColumn("group", F.floor(F.col("block") / fanout)), groups, ["symbol", "group"], F.col("block") + 1, "beside")
    d = step(d, symbols, ["symbol"], F.col("group") + 1, "beyond")
    far = F.when(F.col("near").isNull() & F.col("beside").isNull(), F.col("beyond.at"))
    d = step(d.withColumn("group", far), groups, ["symbol", "group"], F.lit(0), "there")
    last = F.when(F.col("near").isNull(), F.coalesce("beside.at", "there.at"))
    d = step(d.withColumn("block", last), leaves, ["symbol", "block"], F.lit(0), "found")
    x = F.coalesce("near", "found")
    return d.select("key", x["date"].alias("exit_date"), x["open"].alias("open"), x["high"].alias("high"), x["low"].alias("low")).where("exit_date is not null")


def barrier_exits(signals: DataFrame, bars: DataFrame, horizon: int | None = None, *, fanout: int = 64) -> DataFrame:
    """Exit of every signal (date, symbol, stop, target): entry at the next session's open, exit at the first touch from then on.

    The stop wins a session that touches both; gaps fill at the open; with ``horizon`` a touch more than so many days after the fill
    does not count. One window numbers a symbol's bars and brings each signal its entry; the touch is found by ``first_touches``.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars.withColumn("at", (F.row_number().over(w) - 1).cast("long"))
    fills = rows.select("symbol", "date", F.lead("date").over(w).alias("fill_date"), F.lead("open").over(w).alias("fill"), (F.col("at") + 1).alias("at"))
    s = signals.join(fills, ["symbol", "date"]).where("fill_date is not null")
    asked = s.select(F.struct("symbol", "date").alias("key"), "symbol", "at", "stop", "target")
    hits = first_touches(asked, rows, fanout=fanout).select("key.symbol", "key.date", F.struct("exit_date", "open", "high", "low").alias("x"))
    d = s.join(hits.dropDuplicates(["symbol", "date"]), ["symbol", "date"], "left")
    if horizon:
        d = d.withColumn("x", F.when(F.col("x.exit_date") <= F.date_add("fill_date", horizon), F.col("x")))
    stopped = F.col("x.low") <= F.col("stop")
    price = F.when(stopped, F.least("x.open", "stop")).otherwise(F.greatest("x.open", "target"))
    reason = F.when(F.col("x").isNull(), "open").when(stopped, "stop").otherwise("target")
    return d.select("symbol", "date", "fill_date", "fill", F.col("x.exit_date").alias("exit_date"), F.when(F.col("x").isNotNull(), price).alias("exit_price"), reason.alias("exit_reason"))


def closed_out(trades: DataFrame, bars: DataFrame, days: int = 20) -> DataFrame:
    """``trades`` (symbol, entry_date, entry) with exit_date and exit: the first close ``days`` or more after entry, null if none yet.

    Trades and bars lie in one order, the latest first, and one running window hands each trade the last bar it saw.
    """
    bar = bars.where("close is not null").select("symbol", F.col("date").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("date").alias("exit_date"), F.col("close").alias("exit")).alias("_bar"))
    asked = trades.withColumns({"_at": F.date_add("entry_date", days), "_kind": F.lit(1)})
    w = Window.partitionBy("symbol").orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    d = asked.unionByName(bar, allowMissingColumns=True).withColumn("_bar", F.last("_bar", ignorenulls=True).over(w))
    return d.where("_kind = 1").select(*trades.columns, "_bar.exit_date", "_bar.exit")


def trade_metrics(trades: DataFrame, *keys: str) -> DataFrame:
    """Profit factor, win rate and expectancy of closed trades; the result is the first known of net, plain, gross and percent."""
    pnl = F.coalesce(*[F.col(c) for c in ("net_pnl", "pnl", "gross_pnl", "return_pct") if c in trades.columns])
    d = trades.where("exit_date is not null").withColumn("_p", pnl)
    won, lost = F.coalesce(F.sum(F.when(F.col("_p") > 0, F.col("_p"))), F.lit(0.0)), -F.coalesce(F.sum(F.when(F.col("_p") < 0, F.col("_p"))), F.lit(0.0))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), F.try_divide(won, lost).alias("profit_factor"), F.avg((F.col("_p") > 0).cast("double")).alias("win_rate"), F.avg("_p").alias("expectancy"))


def book_risk(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """One row: volatility of the book, as if independent, their ratio and the diversification ratio."""
    wi, wj = weights.select(F.col("symbol").alias("i"), F.col("weight").alias("wi")), weights.select(F.col("symbol").alias("j"), F.col("weight").alias("wj"))
    d = cov.join(wi, "i").join(wj, "j").withColumn("c", F.col("wi") * F.col("wj") * F.col("cov"))
    own = F.col("i") == F.col("j")
    d = d.agg(F.sqrt(F.sum("c")).alias("volatility"), F.sqrt(F.sum(F.when(own, F.col("c")))).alias("independent"), F.sum(F.when(own, F.col("wi") * F.sqrt("cov"))).alias("_weighted"))
    return d.select("volatility", "independent", F.try_divide(F.col("volatility"), F.col("independent")).alias("correlation_multiple"), F.try_divide(F.col("_weighted"), F.col("volatility")).alias("diversification"))


def risk_of_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """``book_risk`` over the covariances of ``returns``, of which no pair is made."""
    own = returns.groupBy("symbol").agg(F.var_samp("ret").alias("v")).join(weights, "symbol")
    own = own.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight") * F.col("v"))).alias("independent"), F.sum(F.col("weight") * F.sqrt("v")).alias("_weighted"))
    d = gram.book_variance(returns, weights).select(F.sqrt("variance").alias("volatility")).crossJoin(F.broadcast(own))  # one row each
    return d.select("volatility", "independent", F.try_divide(F.col("volatility"), F.col("independent")).alias("correlation_multiple"), F.try_divide(F.col("_weighted"), F.col("volatility")).alias("diversification"))


def shrunk(wins: Column, total: Column, strength: float = 20.0, prior: float = 0.5) -> Column:
    """A win rate drawn towards its prior."""
    return (wins + strength * prior) / (total + strength)
