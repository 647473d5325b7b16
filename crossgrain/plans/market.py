"""Queries against the market, over predictions and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions import expressions as X
from crossgrain.functions.frames import change, rounding
from crossgrain.operators import books, features, market, metrics
from crossgrain.plans.common import BUCKETS, average_rank_sql, bucketed_sql, out, scored, scored_sql, sql
from crossgrain.plans.evaluation import EQUAL
from crossgrain.plans.features import frame
from crossgrain.plans.registry import query
from crossgrain.sources.bars import bars, bars_sql, table

GRID = """gr AS (SELECT s.symbol, d.date, b.close FROM (SELECT DISTINCT symbol FROM b) s CROSS JOIN (SELECT DISTINCT date FROM b) d LEFT JOIN b ON b.symbol = s.symbol AND b.date = d.date),
 rr AS (SELECT symbol, date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM gr), mk AS (SELECT date, avg(r) AS m FROM rr WHERE r IS NOT NULL GROUP BY date),
 pm AS (SELECT rr.*, m FROM rr LEFT JOIN mk USING (date)), pl AS (SELECT *, lag(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN m END) OVER w AS x, lag(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN r END) OVER w AS y FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY date)),
 bt AS (SELECT *, CASE WHEN count(y) OVER f >= 6 THEN covar_samp(x, y) OVER f / nullif(var_samp(x) OVER f, 0) END AS beta, var_samp(x) OVER f AS vx, var_samp(y) OVER f AS vy, count(y) OVER f AS n FROM pl WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 iv AS (SELECT *, CASE WHEN n >= 6 THEN sqrt(CASE WHEN coalesce(vx, 0) = 0 THEN vy ELSE greatest(vy - beta * beta * vx, 0) END) END AS idio_vol FROM bt)"""


def with_beta(spark, sf) -> DataFrame:
    return market.with_beta(market.with_market(bars(spark, sf, "month")), 12)


@query("W18_rolling_beta", sql(bars_sql("month"), GRID, select="SELECT symbol, date, round(beta, 6) AS beta FROM iv"))
def w18(spark, sf):
    return out(with_beta(spark, sf).select("symbol", "date", "beta"))


@query("W19_idiosyncratic_volatility", sql(bars_sql("month"), GRID, select="SELECT symbol, date, round(idio_vol, 5) AS idio_vol FROM iv"))
def w19(spark, sf):
    return with_beta(spark, sf).select("symbol", "date", rounding("idio_vol", 5).alias("idio_vol"))


RESIDUAL = f"re AS (SELECT symbol, date, r - beta * m AS e FROM iv), rm AS (SELECT symbol, date, {frame('avg($)', 'e', 9, lag=1)} / nullif({frame('stddev_samp($)', 'e', 9, lag=1)}, 0) AS v FROM re)"


@query("W19_residual_momentum", sql(bars_sql("month"), GRID, RESIDUAL, select="SELECT symbol, date, round(v, 5) AS residual_momentum FROM rm"))
def w19b(spark, sf):
    return market.with_residual_momentum(with_beta(spark, sf), 9, 1).select("symbol", "date", rounding("residual_momentum", 5).alias("residual_momentum"))


def top_by(d: DataFrame, column: str, high: bool) -> DataFrame:
    """The top fifth of a date by a metric, ties by symbol."""
    w = Window.partitionBy("date").orderBy(F.desc("k") if high else F.asc("k"), "symbol")
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    d = d.withColumn("k", rounding(column, 5)).where("k is not null").withColumns({"place": F.row_number().over(w).cast("long"), "n": n})
    return d.where(F.col("place") <= F.greatest(F.ceil(F.col("n") * 0.2), F.lit(1))).select("date", "symbol", "place")


def top_sql(source: str, column: str, high: bool) -> str:
    return f"SELECT date, symbol, place FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY k {'DESC' if high else 'ASC'}, symbol) AS place, count(*) OVER (PARTITION BY date) AS n FROM (SELECT date, symbol, round({column}, 5) AS k FROM {source} WHERE {column} IS NOT NULL)) WHERE place <= greatest(ceil(n * 0.2), 1)"


@query("K5_residual_momentum_picks", sql(bars_sql("month"), GRID, RESIDUAL, select=top_sql("rm", "v", True)))
def k5(spark, sf):
    return top_by(market.with_residual_momentum(with_beta(spark, sf), 9, 1), "residual_momentum", True)


@query("K6_low_beta_picks", sql(bars_sql("month"), GRID, select=top_sql("iv", "beta", False)))
def k6(spark, sf):
    return top_by(with_beta(spark, sf), "beta", False)


INDEX = "mc AS (SELECT date, avg(r) AS market FROM (SELECT date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM b) WHERE r IS NOT NULL GROUP BY date), ix AS (SELECT date, exp(sum(ln(1 + market)) OVER (ORDER BY date)) AS level FROM mc)"


@query("W25_market_proxy", sql(bars_sql(), INDEX, select="SELECT date, round(ln(level), 6) AS log_level FROM ix"))
def w25(spark, sf):
    return out(market.proxy_index(bars(spark, sf)).select("date", F.log("level").alias("log_level")))


@query("W26_regimes", sql(bars_sql(), INDEX, "rg AS (SELECT date, CASE WHEN count(level) OVER t = 26 THEN level / avg(level) OVER t - 1 END AS distance, CASE WHEN count(r) OVER v = 13 THEN stddev_samp(r) OVER v * sqrt(52.0) END AS volatility FROM (SELECT date, level, level / lag(level) OVER (ORDER BY date) - 1 AS r FROM ix) WINDOW t AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW), v AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))", select="SELECT date, round(distance,5) distance, round(volatility,5) volatility, CASE WHEN distance IS NULL OR volatility IS NULL THEN 'unknown' WHEN volatility >= 3.0 THEN 'spike' WHEN distance < 0 THEN 'below_trend' WHEN volatility <= 1.0 THEN 'calm' ELSE 'neutral' END AS regime FROM rg"))
def w26(spark, sf):
    d = market.regimes(market.proxy_index(bars(spark, sf)), trend=26, vol=13, per_year=52, target=0.15, spike=3.0, calm=1.0)
    return d.select("date", rounding("distance", 5).alias("distance"), rounding("volatility", 5).alias("volatility"), "regime")


@query("W37_size_proxy", sql(bars_sql(), f"v AS (SELECT symbol, date, close * volume AS v FROM b), m AS (SELECT symbol, date, {frame('median($)', 'v', 60, 20)} AS m FROM v)", select="SELECT symbol, date, round(ln(m), 6) AS size FROM m"))
def w37(spark, sf):
    return out(features.with_traded_value(bars(spark, sf)).select("symbol", "date", F.log("traded_value_60").alias("size")))


@query("W6_standardized", sql(scored_sql(), "t AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM p WHERE date < DATE '1998-01-01')", select="SELECT symbol, date, round(least(greatest((score - m) / s, -10), 10), 6) AS score_s FROM p, t"))
def w6(spark, sf):
    return out(market.standardized(scored(spark, sf), ["score"], F.col("date") < F.lit("1998-01-01").cast("date")).select("symbol", "date", "score_s"))


@query("W34_sequences", sql(scored_sql(), "sq AS (SELECT symbol, date, sum(score) OVER f AS total, count(*) OVER f AS n, forward_return FROM p WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))", select="SELECT symbol, date, round(total, 5) AS total, round(forward_return, 6) AS target FROM sq WHERE n = 8"))
def w34(spark, sf):
    d = market.sequences(scored(spark, sf), ["score", "volume"], 8, "forward_return")
    return d.select("symbol", "date", rounding(F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]), 5).alias("total"), rounding("target", 6).alias("target"))


@query("M6_training_panel", sql(scored_sql(), f"l AS (SELECT symbol, date, 2 * {average_rank_sql('forward_return')} / (count(*) OVER (PARTITION BY date) + 1) - 1 AS label, (score - avg(score) OVER d) / nullif(stddev_pop(score) OVER d, 0) AS z, count(*) OVER d AS names FROM p WINDOW d AS (PARTITION BY date)), dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM l WHERE names >= 5)), c AS (SELECT l.*, CASE WHEN i < floor(n * 0.7) - 1 THEN 'train' WHEN i >= floor(n * 0.7) AND i < floor(n * 0.85) - 1 THEN 'validation' WHEN i >= floor(n * 0.85) THEN 'test' END AS role FROM l JOIN dd USING (date) WHERE names >= 5)", select="SELECT symbol, date, round(label, 6) AS label, round(coalesce(least(greatest(coalesce(z, 0), -10), 10), 0), 6) AS score_z, role FROM c WHERE role IS NOT NULL"))
def m6(spark, sf):
    from crossgrain.functions.frames import percentile_rank
    from crossgrain.operators.pit import zscored

    d = scored(spark, sf).withColumn("label", 2 * percentile_rank("forward_return") - 1)
    return out(market.chronological_split(zscored(d, ["score"])).select("symbol", "date", "label", "score_z", "role"))


VOLS = f"vs AS (SELECT symbol, date, {frame('stddev_samp($)', 'ret', 26, 20)} AS volatility FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM b))"


@query("G17_scheme_comparison", sql(scored_sql(), bucketed_sql(), EQUAL, VOLS, f"iv AS (SELECT q.date, q.forward_return, CASE WHEN volatility > 0 THEN 1 / volatility END AS i FROM q LEFT JOIN vs USING (symbol, date) WHERE bucket = {BUCKETS - 1}), iw AS (SELECT date, forward_return, CASE WHEN count(i) OVER d < 2 THEN 1.0 / count(*) OVER d ELSE coalesce(i / sum(i) OVER d, 0) END AS weight FROM iv WINDOW d AS (PARTITION BY date)), al AS (SELECT 'equal' AS scheme, date, sum(weight * forward_return) AS r, max(weight) AS mw FROM eq GROUP BY date UNION ALL SELECT 'inverse_volatility', date, sum(weight * forward_return), max(weight) FROM iw GROUP BY date)", select="SELECT scheme, count(*) AS dates, round(avg(r),6) mean_gross, round(stddev_samp(r),6) sd, round(max(mw),6) max_weight FROM al GROUP BY scheme"))
def g17(spark, sf):
    from crossgrain.functions.frames import full

    v = bars(spark, sf).withColumn("_r", change("close", 1)).select("symbol", "date", full(F.stddev_samp, "_r", 26, least=20).alias("volatility"))
    p = scored(spark, sf)
    both = books.equal_weights(p, BUCKETS).withColumn("scheme", F.lit("equal")).unionByName(books.inverse_volatility_weights(p.join(v, ["symbol", "date"], "left"), BUCKETS).withColumn("scheme", F.lit("inverse_volatility")))
    daily = both.groupBy("scheme", "date").agg(F.sum(F.col("weight") * F.col("forward_return")).alias("r"), F.max("weight").alias("w"))
    return out(daily.groupBy("scheme").agg(F.count(F.lit(1)).alias("dates"), F.avg("r").alias("mean_gross"), F.stddev_samp("r").alias("sd"), F.max("w").alias("max_weight")))


MONTHLY = "rt AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM b)"


@query("G24_probabilistic_sharpe")
def g24(spark, sf):
    """Probability that a symbol's Sharpe ratio is over 0, from its own skewness and kurtosis."""
    r = bars(spark, sf, "month").select("symbol", "date", change("close", 1).alias("ret"))
    m = books.moments(r, "ret", "symbol")
    s = F.try_divide(F.col("mean"), F.col("sd"))
    z = s * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s, F.lit(1e-12)))
    return m.select("symbol", "n", rounding(s, 6).alias("sharpe"), rounding(X.normal_cdf(z), 6).alias("psr"))


@query("G25_distinct_trials", sql(bars_sql("month"), MONTHLY, "tr AS (SELECT symbol, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe, CASE WHEN CAST(symbol AS INTEGER) % 5 = 0 THEN NULL ELSE CAST(CAST(symbol AS INTEGER) % 20 AS VARCHAR) END AS hash FROM rt GROUP BY symbol), ds AS (SELECT * FROM tr WHERE hash IS NULL UNION ALL SELECT * FROM tr WHERE hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash ORDER BY CAST(symbol AS INTEGER)) = 1)", select="SELECT count(*) AS trials, round(var_samp(sharpe), 8) AS variance FROM ds"))
def g25(spark, sf):
    n = F.col("symbol").cast("int")
    t = bars(spark, sf, "month").select("symbol", change("close", 1).alias("ret")).groupBy("symbol").agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"))
    t = t.withColumn("hash", F.when(n % 5 != 0, (n % 20).cast("string")))
    first = F.row_number().over(Window.partitionBy("hash").orderBy(n))
    kept = t.where("hash is null").unionByName(t.where("hash is not null").withColumn("i", first).where("i = 1").drop("i"))
    return kept.agg(F.count(F.lit(1)).alias("trials"), rounding(F.var_samp("sharpe"), 8).alias("variance"))


PRED = f"pd AS (SELECT date, symbol, {average_rank_sql('score')} / (count(*) OVER (PARTITION BY date) + 1) AS p, CASE WHEN forward_return > 0 THEN 1.0 ELSE 0.0 END AS won, score, forward_return FROM p)"


def predictions(spark, sf) -> DataFrame:
    from crossgrain.functions.frames import percentile_rank

    return scored(spark, sf).withColumns({"p": percentile_rank("score"), "won": F.when(F.col("forward_return") > 0, 1.0).otherwise(0.0)})


@query("G37_calibration_error", sql(scored_sql(), PRED, "bn AS (SELECT ceil(round(p * 10, 9)) AS bin, count(*) AS n, abs(avg(p) - avg(won)) AS gap FROM pd GROUP BY 1)", select="SELECT round(sum(n * gap) / sum(n), 6) AS calibration_error, count(*) AS bins FROM bn"))
def g37(spark, sf):
    b = predictions(spark, sf).groupBy(F.ceil(rounding(F.col("p") * 10, 9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("won")).alias("gap"))
    return out(b.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("calibration_error"), F.count(F.lit(1)).alias("bins")))


@query("G38_prediction_scores", sql(scored_sql(), PRED, select="SELECT round(avg(pow(p - won, 2)), 6) AS mse, round(avg(CASE WHEN sign(score) = sign(forward_return) THEN 1.0 ELSE 0.0 END), 6) AS direction, round(avg(sign(score) * forward_return) / stddev_samp(sign(score) * forward_return), 6) AS strategy_sharpe, round(avg(forward_return) / stddev_samp(forward_return), 6) AS benchmark_sharpe FROM pd"))
def g38(spark, sf):
    s = F.signum("score") * F.col("forward_return")
    return out(predictions(spark, sf).agg(F.avg(F.pow(F.col("p") - F.col("won"), 2)).alias("mse"), F.avg((F.signum("score") == F.signum("forward_return")).cast("double")).alias("direction"), (F.avg(s) / F.stddev_samp(s)).alias("strategy_sharpe"), (F.avg("forward_return") / F.stddev_samp("forward_return")).alias("benchmark_sharpe")))


LEVELS = (0.1, 0.5, 0.9)


@query("G45_pinball_loss", sql(scored_sql(), PRED, "ql AS (SELECT list_sort([p - 0.6 * won, p - 0.5, 0.4 - p]) AS q, forward_return AS y FROM pd)", select="SELECT " + ", ".join(f"round(avg(greatest({a} * (y - q[{i + 1}]), ({a} - 1) * (y - q[{i + 1}]))), 6) AS q{int(a * 100)}" for i, a in enumerate(LEVELS)) + " FROM ql"))
def g45(spark, sf):
    """Crossed quantiles are put in order first."""
    d = predictions(spark, sf).withColumn("q", F.array_sort(F.array(F.col("p") - 0.6 * F.col("won"), F.col("p") - 0.5, 0.4 - F.col("p"))))
    loss = lambda i, a: F.avg(F.greatest(a * (F.col("forward_return") - F.col("q")[i]), (a - 1) * (F.col("forward_return") - F.col("q")[i])))
    return out(d.agg(*[loss(i, a).alias(f"q{int(a * 100)}") for i, a in enumerate(LEVELS)]))


@query("P22_prediction_signals", sql(scored_sql(), PRED, select="SELECT date, symbol, round(p, 6) AS p, CASE WHEN round(p, 9) >= 0.6 THEN 'BUY' WHEN round(p, 9) <= 0.4 THEN 'SELL' ELSE 'HOLD' END AS signal FROM pd"))
def p22(spark, sf):
    k = rounding("p", 9)
    return predictions(spark, sf).select("date", "symbol", rounding("p", 6).alias("p"), F.when(k >= 0.6, "BUY").when(k <= 0.4, "SELL").otherwise("HOLD").alias("signal"))


@query("G44_simple_performance", sql(scored_sql(), bucketed_sql(), EQUAL, "dr AS (SELECT date, sum(weight * forward_return) AS r FROM eq GROUP BY date)", select="SELECT count(*) AS periods, round(sum(ln(1 + r)), 6) AS log_total, round(exp(sum(ln(1 + r)) * 52.0 / count(*)) - 1, 6) AS annual, round(stddev_samp(r) * sqrt(52.0), 6) AS volatility, round(avg(r) / stddev_samp(r) * sqrt(52.0), 6) AS sharpe, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM dr"))
def g44(spark, sf):
    d = books.equal_weights(scored(spark, sf), BUCKETS).groupBy("date").agg(F.sum(F.col("weight") * F.col("forward_return")).alias("r"))
    total = F.sum(F.log1p("r"))
    return out(d.agg(F.count(F.lit(1)).alias("periods"), total.alias("log_total"), (F.exp(total * 52.0 / F.count(F.lit(1))) - 1).alias("annual"), (F.stddev_samp("r") * 52**0.5).alias("volatility"), (F.avg("r") / F.stddev_samp("r") * 52**0.5).alias("sharpe"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate")))


@query("G42_fingerprint", sql(bars_sql(), "h AS (SELECT symbol, md5(string_agg(CAST(date AS VARCHAR) || '|' || CAST(CAST(floor(close * 10000 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY date)) AS m, count(*) AS n FROM b GROUP BY symbol)", select="SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS symbols, CAST(bit_xor(CAST('0x' || substr(md5(symbol), 1, 15) AS BIGINT)) AS BIGINT) AS universe, CAST(bit_xor(CAST('0x' || substr(md5(symbol || m), 1, 15) AS BIGINT)) AS BIGINT) AS content FROM h"))
def g42(spark, sf):
    """Of the names and of what was read: a hash for each symbol's series, brought together in any order."""
    line = F.concat_ws("|", F.col("date").cast("string"), F.floor(F.col("close") * 10000 + 0.5).cast("long").cast("string"))
    h = bars(spark, sf).groupBy("symbol").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", line.alias("l")))), lambda x: x["l"]), ",").cast("binary")).alias("m"), F.count(F.lit(1)).alias("n"))
    number = lambda c: F.conv(F.left(F.md5(c.cast("binary")), F.lit(15)), 16, 10).cast("long")
    return h.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("symbols"), F.bit_xor(number(F.col("symbol"))).alias("universe"), F.bit_xor(number(F.concat("symbol", "m"))).alias("content"))


@query("J7_exposures", sql(scored_sql(), GRID.replace("gr AS", "gr AS", 1), select="SELECT p.date, p.symbol, round(p.score, 6) AS score, round(beta, 6) AS beta FROM p LEFT JOIN iv ON p.symbol = iv.symbol AND p.date = iv.date").replace("count(y) OVER f >= 6", "count(y) OVER f >= 13").replace("ROWS BETWEEN 11 PRECEDING", "ROWS BETWEEN 25 PRECEDING").replace("n >= 6", "n >= 13"))
def j7(spark, sf):
    beta = market.with_beta(market.with_market(bars(spark, sf)), 26).select("symbol", "date", "beta")
    return out(scored(spark, sf).join(beta, ["symbol", "date"], "left").select("date", "symbol", "score", "beta"))


OPEN = "op AS (SELECT symbol, date AS entry_date, close AS entry FROM b WHERE month(date) = 6 AND day(date) <= 7)"


@query("J13_close_out", sql(bars_sql(), OPEN, "x AS (SELECT op.symbol, entry_date, entry, min(date) AS exit_date FROM op JOIN b ON b.symbol = op.symbol AND date >= entry_date + 20 GROUP BY ALL)", select="SELECT op.symbol, op.entry_date, x.exit_date, round(close / op.entry * 100 - 100, 4) AS return_pct, CASE WHEN x.exit_date IS NULL THEN 'PENDING' WHEN close > op.entry THEN 'WIN' ELSE 'LOSS' END AS outcome FROM op LEFT JOIN x USING (symbol, entry_date) LEFT JOIN b ON b.symbol = op.symbol AND b.date = x.exit_date"))
def j13(spark, sf):
    """Open trades end at the first close 20 days or more after entry."""
    b = bars(spark, sf)
    t = b.where("month(date) = 6 and day(date) <= 7").select("symbol", F.col("date").alias("entry_date"), F.col("close").alias("entry"))
    d = books.closed_out(t, b)
    return d.select("symbol", "entry_date", "exit_date", rounding(F.col("exit") / F.col("entry") * 100 - 100, 4).alias("return_pct"), F.when(F.col("exit_date").isNull(), "PENDING").when(F.col("exit") > F.col("entry"), "WIN").otherwise("LOSS").alias("outcome"))


@query("J17_marked_positions", sql(bars_sql(), "lots AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, sum(l_quantity) AS quantity, sum(l_extendedprice) / sum(l_quantity) AS cost, min(CAST(l_shipdate AS DATE)) AS since FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), lc AS (SELECT symbol, last(close ORDER BY date) AS mark, max(date) AS marked FROM b WHERE date <= DATE '1998-01-01' GROUP BY symbol)", select="SELECT symbol, round(quantity, 2) AS quantity, round(cost, 4) AS cost, round(mark * quantity, 2) AS value, date_diff('day', since, marked) AS days FROM lots LEFT JOIN lc USING (symbol)"))
def j17(spark, sf):
    lots = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").cast("string").alias("symbol")).agg(F.sum("l_quantity").alias("quantity"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("cost"), F.min(F.to_date("l_shipdate")).alias("since"))
    marks = bars(spark, sf).where("date <= date'1998-01-01'").groupBy("symbol").agg(F.max_by("close", "date").alias("mark"), F.max("date").alias("marked"))
    return lots.join(marks, "symbol", "left").select("symbol", rounding("quantity", 2).alias("quantity"), rounding("cost", 4).alias("cost"), rounding(F.col("mark") * F.col("quantity"), 2).alias("value"), F.date_diff("marked", "since").cast("long").alias("days"))


@query("J14_delisted", sql(bars_sql(), select="SELECT symbol, max(date) AS last_date, round(last(close ORDER BY date), 4) AS exit_price FROM b GROUP BY symbol HAVING max(date) < (SELECT max(date) FROM b)"))
def j14(spark, sf):
    b = bars(spark, sf)
    ends = b.groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("exit_price"))
    return ends.crossJoin(F.broadcast(b.agg(F.max("date").alias("today")))).where("last_date < today").select("symbol", "last_date", rounding("exit_price", 4).alias("exit_price"))


FLOWS = "fw AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS fii_net, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS dii_net FROM orders GROUP BY 1)"


@query("W21_flow_states", sql(FLOWS, "t AS (SELECT date, CASE WHEN count(*) OVER w = 63 THEN sum(fii_net - dii_net) OVER w END AS net FROM fw WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))", select="SELECT date, round(net, 2) AS net, CASE WHEN net > 0 THEN 'inflow' WHEN net <= 0 THEN 'outflow' END AS state FROM t"))
def flow_states(spark, sf):
    o = table(spark, sf, "orders")
    f = o.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)) - F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0))).alias("market"))
    d = metrics.trailing_state(f, 63)
    return d.select("date", rounding("trailing", 2).alias("net"), F.when(F.col("state") == "up", "inflow").when(F.col("state") == "down", "outflow").alias("state"))


@query("M3_pair_tests")
def m3(spark, sf):
    """All pairs of symbols with whole histories; lagged differences by AIC. No SQL: J10 has it for tests without lags."""
    b = bars(spark, sf, "month")
    nearest = market.pair_tests(b, lags=None, nearest=50, digits=None)
    return out(market.selected_pairs(market.pair_tests(b, lags=None), tested=market.tested_pairs(b), nearest=nearest))
