"""Queries over books, equity curves, trades and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding
from crossgrain.functions import expressions as X
from crossgrain.operators import books, gram
from crossgrain.operators import features as ft
from crossgrain.plans.common import BUCKETS, bucketed_sql, out, scored, scored_sql, sql
from crossgrain.plans.features import frame
from crossgrain.plans.registry import query
from crossgrain.sources.bars import bars, bars_sql, table

CURVES = """mr AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM b), nr AS (SELECT n_name AS book_id, date, avg(least(greatest(ret, -0.2), 0.2)) AS r FROM mr JOIN supplier ON CAST(s_suppkey AS VARCHAR) = symbol JOIN nation ON s_nationkey = n_nationkey WHERE ret IS NOT NULL GROUP BY ALL),
 cu AS (SELECT book_id, date, round(100 * exp(sum(ln(1 + r)) OVER (PARTITION BY book_id ORDER BY date)), 6) AS value FROM nr)"""


def curves(spark, sf) -> DataFrame:
    """A curve per nation: compounded means of its suppliers' clipped monthly returns."""
    m = bars(spark, sf, "month").select("symbol", "date", ft.change("close", 1).alias("ret")).where("ret is not null")
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("n_name").alias("book_id"))
    r = m.join(s, "symbol").groupBy("book_id", "date").agg(F.avg(F.least(F.greatest("ret", F.lit(-0.2)), F.lit(0.2))).alias("r"))
    w = Window.partitionBy("book_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("book_id", "date", rounding(100 * F.exp(F.sum(F.log1p("r")).over(w)), 6).alias("value"))


@query("W27_underwater", sql(bars_sql("month"), CURVES, select="SELECT book_id, date, round(value,4) AS value, round(max(value) OVER w,4) AS peak, round(value / max(value) OVER w - 1, 6) AS drawdown FROM cu WINDOW w AS (PARTITION BY book_id ORDER BY date)"))
def w27(spark, sf):
    d = books.underwater(curves(spark, sf))
    return d.select("book_id", "date", rounding("value", 4).alias("value"), rounding("peak", 4).alias("peak"), (rounding("drawdown", 6) + 0.0).alias("drawdown"))


@query("W28_drawdown_duration", sql(bars_sql("month"), CURVES, """u AS (SELECT *, max(value) OVER (PARTITION BY book_id ORDER BY date) AS peak FROM cu), lo AS (SELECT book_id, first(date ORDER BY value / peak, date) AS trough, first(value / peak - 1 ORDER BY value / peak, date) AS depth, first(peak ORDER BY value / peak, date) AS high, max(date) AS e FROM u GROUP BY book_id),
 r AS (SELECT u.book_id, trough, depth, e, max(date) FILTER (WHERE date <= trough AND value = high) AS peak_date, min(date) FILTER (WHERE date > trough AND value >= high) AS recovery FROM u JOIN lo USING (book_id) GROUP BY ALL)""", select="SELECT book_id, trough, round(depth,6) depth, peak_date, recovery, date_diff('day', peak_date, coalesce(recovery, e)) AS days FROM r"))
def w28(spark, sf):
    return out(books.drawdown_duration(curves(spark, sf)).select("book_id", "trough", "depth", "peak_date", "recovery", "days"))


@query("G20_curve_metrics", sql(bars_sql("month"), CURVES, """u AS (SELECT *, value / max(value) OVER w - 1 AS dd, value / lag(value) OVER w - 1 AS r FROM cu WINDOW w AS (PARTITION BY book_id ORDER BY date)),
 g AS (SELECT book_id, first(value ORDER BY date) AS f, last(value ORDER BY date) AS l, count(r) AS n, stddev_samp(r) AS sd, avg(r - 0.06 / 12) AS m, sqrt(avg(pow(least(r - 0.06 / 12, 0), 2))) AS dn, min(dd) AS mdd FROM u GROUP BY book_id)""", select="SELECT book_id, round(l/f-1,6) total_return, round(pow(l/f, 12.0/n)-1,6) cagr, round(sd*sqrt(12.0),6) volatility, round(m/sd*sqrt(12.0),6) sharpe, round(m/dn*sqrt(12.0),6) sortino, round(mdd,6) max_drawdown, round((pow(l/f,12.0/n)-1)/abs(mdd),6) calmar FROM g"))
def g20(spark, sf):
    return out(books.curve_metrics(curves(spark, sf), 12, 0.06))


@query("G39_monthly_table", sql(bars_sql("month"), CURVES, "mo AS (SELECT book_id, year(date) AS year, month(date) AS m, value / lag(value) OVER (PARTITION BY book_id ORDER BY date) - 1 AS r FROM cu)", select="SELECT book_id, year, " + ", ".join(f"round(max(r) FILTER (WHERE m = {i}),6) AS m{i:02d}" for i in range(1, 13)) + " FROM mo GROUP BY ALL"))
def g39(spark, sf):
    return out(books.monthly_table(curves(spark, sf)))


MONTHLY = "rt AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM b)"


@query("G23_return_moments", sql(bars_sql("month"), MONTHLY, select="SELECT symbol, count(ret) AS n, round(avg(ret),6) mean, round(stddev_samp(ret),6) sd, round(avg(pow(z,3)),4) skew, round(avg(pow(z,4)),4) kurtosis FROM (SELECT symbol, ret, (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w AS z FROM rt WINDOW w AS (PARTITION BY symbol)) GROUP BY symbol"))
def g23(spark, sf):
    d = books.moments(monthly_returns(spark, sf), "ret", "symbol")
    return d.select("symbol", "n", rounding("mean", 6).alias("mean"), rounding("sd", 6).alias("sd"), rounding("skew", 4).alias("skew"), rounding("kurtosis", 4).alias("kurtosis"))


def monthly_returns(spark, sf) -> DataFrame:
    return bars(spark, sf, "month").select("symbol", "date", ft.change("close", 1).alias("ret"))


@query("G21_sharpe_ratio", sql(bars_sql("month"), MONTHLY, select="SELECT symbol, round(CASE WHEN stddev_samp(ret - 0.005) > 0 THEN avg(ret - 0.005) / stddev_samp(ret - 0.005) * sqrt(12.0) ELSE 0 END, 6) AS sharpe FROM rt WHERE ret IS NOT NULL GROUP BY symbol"))
def g21(spark, sf):
    d = monthly_returns(spark, sf).where("ret is not null").withColumn("x", F.col("ret") - 0.005).groupBy("symbol")
    sd = F.stddev_samp("x")
    return out(d.agg(F.when(sd > 0, F.avg("x") / F.when(sd > 0, sd) * 12**0.5).otherwise(0.0).alias("sharpe")))


@query("G18_drift_statistics", sql(bars_sql("month"), MONTHLY, select="SELECT symbol, round(avg(ln(1+ret)),6) mu, round(stddev_pop(ln(1+ret)),6) sigma, count(ret) AS n FROM rt WHERE ret IS NOT NULL GROUP BY symbol"))
def g18(spark, sf):
    d = monthly_returns(spark, sf).where("ret is not null").groupBy("symbol")
    return out(d.agg(F.avg(F.log1p("ret")).alias("mu"), F.stddev_pop(F.log1p("ret")).alias("sigma"), F.count("ret").alias("n")))


PRIOR = "ds AS (SELECT symbol, avg(ln(1+ret)) AS mu, stddev_pop(ln(1+ret)) AS sigma, count(ret) AS n FROM rt WHERE ret IS NOT NULL GROUP BY symbol), pr AS (SELECT avg(mu) AS m, greatest(0, var_samp(mu) - avg(sigma*sigma/n)) AS tau2 FROM ds)"


@query("G19_shrunk_drift", sql(bars_sql("month"), MONTHLY, PRIOR, select="SELECT symbol, round((mu * tau2 + m * sigma*sigma/n) / (tau2 + sigma*sigma/n), 6) AS posterior, round(sqrt(tau2 * (sigma*sigma/n) / (tau2 + sigma*sigma/n)), 6) AS sd, round((sigma*sigma/n) / (tau2 + sigma*sigma/n), 6) AS shrinkage FROM ds, pr"))
def g19(spark, sf):
    d = monthly_returns(spark, sf).where("ret is not null").groupBy("symbol").agg(F.avg(F.log1p("ret")).alias("mu"), F.stddev_pop(F.log1p("ret")).alias("sigma"), F.count("ret").alias("n"))
    d = d.withColumn("noise", F.col("sigma") * F.col("sigma") / F.col("n"))
    prior = d.agg(F.avg("mu").alias("m"), F.greatest(F.lit(0.0), F.var_samp("mu") - F.avg("noise")).alias("tau2"))
    total = F.col("tau2") + F.col("noise")
    return out(d.crossJoin(F.broadcast(prior)).select("symbol", ((F.col("mu") * F.col("tau2") + F.col("m") * F.col("noise")) / total).alias("posterior"), F.sqrt(F.col("tau2") * F.col("noise") / total).alias("sd"), (F.col("noise") / total).alias("shrinkage")))


FEW = "fr AS (SELECT * FROM rt WHERE ret IS NOT NULL), cv AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) AS cov FROM fr a JOIN fr b USING (date) GROUP BY ALL)"


def book_returns_of_all(spark, sf) -> DataFrame:
    """The returns of all names. A covariance is a row for each two of them: names squared, whatever the dates."""
    return monthly_returns(spark, sf).where("ret is not null")


@query("G31_covariance", sql(bars_sql("month"), MONTHLY, FEW, select="SELECT i, j, round(cov, 6) AS cov FROM cv"))
def g31(spark, sf):
    return out(gram.covariance(book_returns_of_all(spark, sf)))


@query("G30_book_risk", sql(bars_sql("month"), MONTHLY, FEW, "w AS (SELECT DISTINCT symbol, 1.0 / (SELECT count(DISTINCT symbol) FROM fr) AS weight FROM fr), c AS (SELECT cv.*, a.weight * b.weight * cov AS c, a.weight AS wi FROM cv JOIN w a ON a.symbol = i JOIN w b ON b.symbol = j)", select="SELECT round(sqrt(sum(c)),6) volatility, round(sqrt(sum(c) FILTER (WHERE i=j)),6) independent, round(sqrt(sum(c))/sqrt(sum(c) FILTER (WHERE i=j)),6) correlation_multiple, round(sum(wi*sqrt(cov)) FILTER (WHERE i=j)/sqrt(sum(c)),6) diversification FROM c"))
def g30(spark, sf):
    r = book_returns_of_all(spark, sf)
    names = r.select("symbol").distinct()
    n = names.agg(F.count(F.lit(1)).alias("n"))
    weights = names.crossJoin(F.broadcast(n)).select("symbol", (1.0 / F.col("n")).alias("weight"))
    return out(books.risk_of_returns(weights, r))


@query("G33_single_factor_covariance", sql(bars_sql("month"), MONTHLY, FEW, "f AS (SELECT date, avg(ret) AS m FROM fr GROUP BY date), be AS (SELECT symbol, regr_slope(ret, m) AS beta, var_samp(ret) - pow(regr_slope(ret, m), 2) * var_samp(m) AS own FROM fr JOIN f USING (date) GROUP BY symbol), vf AS (SELECT var_samp(m) AS v FROM f)", select="SELECT a.symbol AS i, b.symbol AS j, round(a.beta * b.beta * v + CASE WHEN a.symbol = b.symbol THEN greatest(a.own, 0) ELSE 0 END, 6) AS cov FROM be a, be b, vf"))
def g33(spark, sf):
    r = book_returns_of_all(spark, sf)
    f = r.groupBy("date").agg(F.avg("ret").alias("m"))
    slope = F.regr_slope("ret", "m")
    be = r.join(f, "date").groupBy("symbol").agg(slope.alias("beta"), (F.var_samp("ret") - slope * slope * F.var_samp("m")).alias("own"))
    v = f.agg(F.var_samp("m").alias("v"))
    return out(gram.single_factor(be.crossJoin(F.broadcast(v))))  # v is one row


VOLS = f"vs AS (SELECT symbol, date, {frame('stddev_samp($)', 'ret', 26, 20)} AS volatility FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM b))"


@query("E7_inverse_volatility_book", sql(scored_sql(), bucketed_sql(), VOLS, f"iv AS (SELECT q.date, q.symbol, CASE WHEN volatility > 0 THEN 1 / volatility END AS i FROM q LEFT JOIN vs USING (symbol, date) WHERE bucket = {BUCKETS - 1})", select="SELECT date, symbol, round(CASE WHEN count(i) OVER d < 2 THEN 1.0 / count(*) OVER d ELSE coalesce(i / sum(i) OVER d, 0) END, 6) AS weight FROM iv WINDOW d AS (PARTITION BY date)"))
def e7(spark, sf):
    from crossgrain.functions.frames import full

    v = bars(spark, sf).withColumn("_r", ft.change("close", 1))
    v = v.select("symbol", "date", full(F.stddev_samp, "_r", 26, least=20).alias("volatility"))
    d = books.inverse_volatility_weights(scored(spark, sf).join(v, ["symbol", "date"], "left"), BUCKETS)
    return out(d.select("date", "symbol", "weight"))


SIGNALS = "sg AS (SELECT symbol, date, round(close * 0.7, 2) AS stop, round(close * 1.5, 2) AS target FROM b WHERE month(date) = 3 AND day(date) <= 7)"
EXITS = """fi AS (SELECT symbol, date, lead(date) OVER w AS fill_date, lead(open) OVER w AS fill FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)), s AS (SELECT * FROM sg JOIN fi USING (symbol, date) WHERE fill_date IS NOT NULL),
 hx AS (SELECT s.symbol, s.date, min(b.date) AS exit_date FROM s JOIN b ON b.symbol = s.symbol AND b.date >= fill_date AND (low <= stop OR high >= target) GROUP BY ALL),
 ex AS (SELECT s.symbol, s.date, fill_date, fill, exit_date, CASE WHEN low <= stop THEN least(open, stop) WHEN exit_date IS NOT NULL THEN greatest(open, target) END AS exit_price, CASE WHEN exit_date IS NULL THEN 'open' WHEN low <= stop THEN 'stop' ELSE 'target' END AS exit_reason FROM s LEFT JOIN hx USING (symbol, date) LEFT JOIN b ON b.symbol = s.symbol AND b.date = exit_date)"""


def exits(spark, sf) -> DataFrame:
    b = bars(spark, sf)
    signals = b.where("month(date) = 3 and day(date) <= 7").select("symbol", "date", rounding(F.col("close") * 0.7, 2).alias("stop"), rounding(F.col("close") * 1.5, 2).alias("target"))
    return books.barrier_exits(signals, b)


@query("J12_barrier_exits", sql(bars_sql(), SIGNALS, EXITS, select="SELECT symbol, date, fill_date, round(fill,4) fill, exit_date, round(exit_price,4) exit_price, exit_reason FROM ex"))
def j12(spark, sf):
    return exits(spark, sf).select("symbol", "date", "fill_date", rounding("fill", 4).alias("fill"), "exit_date", rounding("exit_price", 4).alias("exit_price"), "exit_reason")


BUY, SELL = X.cost_per_side("BUY"), X.cost_per_side("SELL")
TRADES = f"td AS (SELECT *, exit_price * (1 - {SELL!r}) / (fill * (1 + {BUY!r})) * 100 - 100 AS return_pct FROM ex)"


def trades(spark, sf) -> DataFrame:
    return exits(spark, sf).withColumn("return_pct", X.net_return_pct(F.col("fill"), F.col("exit_price"), BUY, SELL))


@query("P12_net_trades", sql(bars_sql(), SIGNALS, EXITS, TRADES, select="SELECT symbol, date, round(return_pct,4) return_pct, CASE WHEN return_pct > 0 THEN 'WIN' WHEN return_pct IS NOT NULL THEN 'LOSS' END AS outcome FROM td"))
def p12(spark, sf):
    r = F.col("return_pct")
    return trades(spark, sf).select("symbol", "date", rounding(r, 4).alias("return_pct"), F.when(r > 0, "WIN").when(r.isNotNull(), "LOSS").alias("outcome"))


@query("G22_trade_metrics", sql(bars_sql(), SIGNALS, EXITS, TRADES, select="SELECT exit_reason, count(*) AS trades, round(sum(return_pct) FILTER (WHERE return_pct > 0) / nullif(-sum(return_pct) FILTER (WHERE return_pct < 0), 0), 4) AS profit_factor, round(avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END),6) win_rate, round(avg(return_pct),4) expectancy FROM td WHERE exit_date IS NOT NULL GROUP BY exit_reason"))
def g22(spark, sf):
    d = books.trade_metrics(trades(spark, sf), "exit_reason")
    lost = F.col("profit_factor") == 0
    return d.select("exit_reason", "trades", F.when(~lost, rounding("profit_factor", 4)).alias("profit_factor"), rounding("win_rate", 6).alias("win_rate"), rounding("expectancy", 4).alias("expectancy"))


@query("G28_kelly_inputs", sql(bars_sql(), SIGNALS, EXITS, TRADES, select="SELECT count(*) AS trades, round((count(*) FILTER (WHERE return_pct > 0) + 10.0) / (count(*) + 20), 6) AS p, round(avg(return_pct) FILTER (WHERE return_pct > 0),4) AS mean_win, round(-avg(return_pct) FILTER (WHERE return_pct <= 0),4) AS mean_loss FROM td WHERE return_pct IS NOT NULL"))
def g28(spark, sf):
    r = F.col("return_pct")
    d = trades(spark, sf).where(r.isNotNull()).agg(F.count(F.lit(1)).alias("trades"), books.shrunk(F.count_if(r > 0), F.count(F.lit(1))).alias("p"), F.avg(F.when(r > 0, r)).alias("mean_win"), (-F.avg(F.when(r <= 0, r))).alias("mean_loss"))
    return d.select("trades", rounding("p", 6).alias("p"), rounding("mean_win", 4).alias("mean_win"), rounding("mean_loss", 4).alias("mean_loss"))


LOTS = "lt AS (SELECT symbol, date, exit_date, greatest(exit_price - close, 0) * 300 AS gain FROM (SELECT symbol, date, close, lead(date, 60) OVER w AS exit_date, lead(close, 60) OVER w AS exit_price FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE date_diff('day', date, exit_date) >= 365)"


@query("W22_running_exemption", sql(bars_sql(), LOTS, "ru AS (SELECT *, least(125000.0, sum(gain) OVER (PARTITION BY symbol ORDER BY exit_date, date ROWS UNBOUNDED PRECEDING)) AS used FROM lt)", select="SELECT symbol, date, round(gain,2) gain, round(used - coalesce(lag(used) OVER (PARTITION BY symbol ORDER BY exit_date, date), 0), 2) AS exempt FROM ru"))
def w22(spark, sf):
    """A lot of 300 at every weekly bar, sold 60 bars later; those held for less than a year have no part in the exemption."""
    s = Window.partitionBy("symbol").orderBy("date")
    d = bars(spark, sf).withColumns({"exit_date": F.lead("date", 60).over(s), "exit_price": F.lead("close", 60).over(s)})
    d = d.where(F.date_diff("exit_date", "date") >= 365).withColumn("gain", F.greatest(F.col("exit_price") - F.col("close"), F.lit(0.0)) * 300)
    w = Window.partitionBy("symbol").orderBy("exit_date", "date")
    d = d.withColumn("used", F.least(F.lit(X.EXEMPTION), F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return d.select("symbol", "date", rounding("gain", 2).alias("gain"), rounding(F.col("used") - F.coalesce(F.lag("used").over(w), F.lit(0.0)), 2).alias("exempt"))
