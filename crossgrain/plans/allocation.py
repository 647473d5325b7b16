"""Queries over allocation and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding
from crossgrain.operators import allocation as al
from crossgrain.operators import books, gram
from crossgrain.operators.features import with_limit_flags
from crossgrain.plans.books import CURVES, EXITS, FEW, MONTHLY, SIGNALS, TRADES, curves, book_returns_of_all, trades
from crossgrain.plans.common import BUCKETS, bucketed_sql, out, scored, scored_sql, sql
from crossgrain.plans.features import FLAGS
from crossgrain.plans.market import FLOWS
from crossgrain.plans.registry import query
from crossgrain.plans.signals import FEATURES_SQL, TYPICAL, select_sql, selected
from crossgrain.sources.bars import bars, bars_sql, table


@query("E8_capped_weights", sql(scored_sql(), bucketed_sql(), f"e1 AS (SELECT date, symbol, 1.0 + CAST(symbol AS INTEGER) % 5 AS x FROM q WHERE bucket = {BUCKETS - 1}), e2 AS (SELECT date, symbol, x / sum(x) OVER (PARTITION BY date) AS w, count(*) OVER (PARTITION BY date) AS n FROM e1), e3 AS (SELECT *, row_number() OVER o - 1 AS k, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM e2 WINDOW o AS (PARTITION BY date ORDER BY w DESC, symbol)), e4 AS (SELECT date, min(k) AS m, arg_min((1 - k * 0.1) / rest, k) AS scale FROM e3 WHERE w * (1 - k * 0.1) / rest <= 0.1 * (1 + 1e-12) GROUP BY date)", select="SELECT e3.date, symbol, round(CASE WHEN n * 0.1 <= 1 THEN 1.0 / n WHEN k < m THEN 0.1 ELSE w * scale END, 6) AS weight FROM e3 LEFT JOIN e4 ON e3.date = e4.date"))
def e8(spark, sf):
    p = scored(spark, sf)
    w = books.equal_weights(p, BUCKETS).withColumn("weight", F.col("weight") * (1 + F.col("symbol").cast("int") % 5))
    from crossgrain.functions.frames import across

    w = w.withColumn("weight", F.col("weight") / F.sum("weight").over(across("date")))
    return out(al.capped(w.select("date", "symbol", "weight"), 0.1))


@query("E10_expected_returns", sql(scored_sql(), select="SELECT date, symbol, round((coalesce((score - min(score) OVER d) / nullif(max(score) OVER d - min(score) OVER d, 0), 0.5) - 0.5) * 0.1, 6) AS expected FROM p WINDOW d AS (PARTITION BY date)"))
def e10(spark, sf):
    p = scored(spark, sf)
    return out(p.select("date", "symbol", al.expected_returns(p, 0.1).alias("expected")))


@query("E11_sleeve_weights", sql(scored_sql(), "sn AS (SELECT date, CASE WHEN forward_return > 0 THEN 'up' ELSE 'down' END AS state, count(*) AS n FROM p GROUP BY 1, 2), st AS (SELECT date, state, n / sum(n) OVER (PARTITION BY date) AS probability FROM sn), af AS (SELECT * FROM (VALUES ('up','trend',0.8),('up','defence',0.2),('down','trend',0.1),('down','defence',0.9)) t(state, sleeve, affinity)), sw AS (SELECT date, sleeve, sum(probability * affinity) AS w FROM st JOIN af USING (state) GROUP BY ALL)", select="SELECT date, sleeve, round(w / sum(w) OVER (PARTITION BY date), 6) AS weight FROM sw"))
def e11(spark, sf):
    from crossgrain.functions.frames import across

    s = scored(spark, sf).groupBy("date", F.when(F.col("forward_return") > 0, "up").otherwise("down").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("probability", F.col("n") / F.sum("n").over(across("date")))
    affinity = spark.createDataFrame([("up", "trend", 0.8), ("up", "defence", 0.2), ("down", "trend", 0.1), ("down", "defence", 0.9)], "state string, sleeve string, affinity double")
    return out(al.sleeve_weights(s, affinity))


@query("G27_learned_weights", sql(bars_sql(), SIGNALS, EXITS, TRADES, "tg AS (SELECT CASE CAST(symbol AS INTEGER) % 3 WHEN 0 THEN 'Trend' WHEN 1 THEN 'Breakout' ELSE 'Volume' END AS trigger, return_pct > 0 AS won FROM td WHERE return_pct IS NOT NULL), c AS (SELECT trigger, count(*) FILTER (WHERE won) AS wins, count(*) AS total FROM tg GROUP BY trigger), r AS (SELECT *, (wins + 10.0) / (total + 20.0) AS rate FROM c), w AS (SELECT *, greatest(CASE trigger WHEN 'Trend' THEN 40 WHEN 'Breakout' THEN 30 ELSE 15 END * rate * 2, 5) AS raw FROM r)", select="SELECT trigger, wins, total, round(rate, 6) AS rate, round(p, 6) AS p_value, round(even + CASE WHEN row_number() OVER (ORDER BY raw DESC, trigger) = 1 THEN 100 - sum(even) OVER () ELSE 0 END, 4) AS weight FROM (SELECT *, floor(1000 * raw / sum(raw) OVER () + 0.5) / 10 AS even, (SELECT least(1.0, sum(exp(lgamma(total + 1) - lgamma(j + 1) - lgamma(total - j + 1) - total * ln(2.0)))) FROM (SELECT unnest(range(greatest(wins, total - wins), total + 1)) AS j)) AS p FROM w)"))
def g27(spark, sf):
    n = F.col("symbol").cast("int") % 3
    t = trades(spark, sf).where("return_pct is not null").select(F.when(n == 0, "Trend").when(n == 1, "Breakout").otherwise("Volume").alias("trigger"), (F.col("return_pct") > 0).alias("won"))
    d = al.learned_weights(t, {"Trend": 40.0, "Breakout": 30.0, "Volume": 15.0})
    return d.select("trigger", "wins", "total", rounding("rate", 6).alias("rate"), rounding("p_value", 6).alias("p_value"), rounding("weight", 4).alias("weight"))


@query("G32_exponential_covariance", sql(bars_sql("month"), MONTHLY, FEW, "dw AS (SELECT date, w / sum(w) OVER () AS w FROM (SELECT date, pow(0.5, (row_number() OVER (ORDER BY date DESC) - 1) / 12.0) AS w FROM (SELECT DISTINCT date FROM fr))), x AS (SELECT fr.symbol, fr.date, w, ret - sum(w * ret) OVER (PARTITION BY symbol) AS d FROM fr JOIN dw USING (date))", select="SELECT a.symbol AS i, b.symbol AS j, round(sum(a.w * a.d * b.d) / (1 - sum(a.w * a.w)), 5) AS cov FROM x a JOIN x b USING (date) GROUP BY ALL"))
def g32(spark, sf):
    d = gram.exponential_covariance(book_returns_of_all(spark, sf), 12.0)
    return d.select("i", "j", rounding("cov", 5).alias("cov"))


@query("G40_executive_summary", sql(bars_sql("month"), CURVES, "x AS (SELECT count(DISTINCT book_id) AS books, count(*) AS rows, max(value) AS best, min(value) AS worst FROM cu)", select="SELECT 'books' AS metric, round(books, 4) AS value, 'count' AS unit FROM x UNION ALL SELECT 'rows', round(rows, 4), 'count' FROM x UNION ALL SELECT 'best', round(best, 4), 'level' FROM x UNION ALL SELECT 'worst', round(worst, 4), 'level' FROM x"))
def g40(spark, sf):
    x = curves(spark, sf).agg(F.count_distinct("book_id").cast("double").alias("books"), F.count(F.lit(1)).cast("double").alias("rows"), F.max("value").alias("best"), F.min("value").alias("worst"))
    d = x.selectExpr("stack(4, 'books', books, 'count', 'rows', rows, 'count', 'best', best, 'level', 'worst', worst, 'level') as (metric, value, unit)")
    return d.select("metric", rounding("value", 4).alias("value"), "unit")


@query("J16_forced_exits", sql(bars_sql(), FLAGS, select="SELECT symbol, date FROM fl WHERE locked_down AND CAST(symbol AS INTEGER) % 2 = 0"))
def j16(spark, sf):
    b = with_limit_flags(bars(spark, sf))
    held = b.select("symbol").distinct().where("cast(symbol as int) % 2 = 0")
    return b.where("locked_down").join(held, "symbol", "left_semi").select("symbol", "date")


@query("P21_verdicts", sql(TYPICAL, FEATURES_SQL, select_sql("mom", True), select="SELECT date, symbol, 'momentum' AS model, signal AS action, round(score / 100, 4) AS confidence, round((target / entry - 1) * score - (1 - stop / entry) * (100 - score), 4) AS expected_net_ev_pct, reject_reason IS NULL AS liquidity_pass FROM so"))
def p21(spark, sf):
    d = al.verdicts(selected(spark, sf, "mom", True), "momentum")
    return d.withColumns({"confidence": rounding("confidence", 4), "expected_net_ev_pct": rounding("expected_net_ev_pct", 4)})


@query("P25_trade_log", sql(bars_sql(), SIGNALS, EXITS, TRADES, select="SELECT symbol || '-' || CAST(date AS VARCHAR) AS trade_id, symbol AS ticker, fill_date AS entry_date, round(fill, 4) AS entry_price, exit_date, round(exit_price, 4) AS exit_price, CAST(100 AS BIGINT) AS quantity, 'BUY' AS side, round(return_pct, 4) AS return_pct, date_diff('day', fill_date, exit_date) AS holding_days, exit_reason FROM td"))
def p25(spark, sf):
    return trades(spark, sf).select(
        F.concat_ws("-", "symbol", F.col("date").cast("string")).alias("trade_id"), F.col("symbol").alias("ticker"), F.col("fill_date").alias("entry_date"), rounding("fill", 4).alias("entry_price"), "exit_date", rounding("exit_price", 4).alias("exit_price"),
        F.lit(100).cast("long").alias("quantity"), F.lit("BUY").alias("side"), rounding("return_pct", 4).alias("return_pct"), F.date_diff("exit_date", "fill_date").cast("long").alias("holding_days"), "exit_reason",
    )


#: Raw lines of a flow table: every order restates its day's flows, and every 50th has no number.
RAW_FLOWS = "rf AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS line, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(round(o_totalprice, 0) AS VARCHAR) END AS fii, CAST(round(o_totalprice / 2, 0) AS VARCHAR) AS dii FROM orders)"


@query("V14_flow_table", sql(FLOWS, select="SELECT date, round(fii_net, 2) AS fii_net, round(dii_net, 2) AS dii_net FROM fw"))
def v14(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(*[F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0)).alias(n) for s, n in (("F", "fii_net"), ("O", "dii_net"))])
    return o.select("date", rounding("fii_net", 2).alias("fii_net"), rounding("dii_net", 2).alias("dii_net"))


@query("V14_flow_validation", sql(RAW_FLOWS, select="SELECT date, fii_net, dii_net, restated FROM (SELECT date, TRY_CAST(fii AS DOUBLE) AS fii_net, TRY_CAST(dii AS DOUBLE) AS dii_net, count(*) OVER (PARTITION BY date) AS restated, row_number() OVER (PARTITION BY date ORDER BY line DESC) AS k FROM rf WHERE TRY_CAST(fii AS DOUBLE) IS NOT NULL AND TRY_CAST(dii AS DOUBLE) IS NOT NULL) WHERE k = 1").replace("round(o_totalprice, 0)", "CAST(floor(o_totalprice + 0.5) AS BIGINT)").replace("round(o_totalprice / 2, 0)", "CAST(floor(o_totalprice / 2 + 0.5) AS BIGINT)"))
def v14_validation(spark, sf):
    """Lines without a number are left out, and of a date's lines the last counts."""
    raw = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.floor(F.col("o_totalprice") + 0.5).cast("string")).alias("fii_net"), F.floor(F.col("o_totalprice") / 2 + 0.5).cast("string").alias("dii_net"))
    return al.validated_flows(raw)


W29 = """br AS (SELECT book_id, i, date, value AS peak, 0 AS since, false AS halted, '' AS event FROM n WHERE i = 1 UNION ALL
 SELECT book_id, i, date, CASE WHEN was AND s >= 10 THEN value ELSE top END, CASE WHEN was AND now THEN s ELSE 0 END, now, CASE WHEN now AND NOT was THEN 'HALT' WHEN was AND NOT now THEN 'RESUME' ELSE '' END FROM (
  SELECT *, CASE WHEN was THEN 1 - value / top > 0.05 AND s < 10 ELSE 1 - value / top >= 0.15 END AS now FROM (
   SELECT n.book_id, n.i, n.date, n.value, greatest(br.peak, n.value) AS top, br.since + 1 AS s, br.halted AS was FROM n JOIN br ON n.book_id = br.book_id AND n.i = br.i + 1)))"""


@query("W29_breaker", "WITH RECURSIVE " + ",".join([bars_sql("month"), CURVES, "n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY date) AS i FROM cu)", W29]) + " SELECT book_id, date, halted, event FROM br")
def w29(spark, sf):
    return al.breaker(curves(spark, sf), halt=0.15, resume=0.05, cooldown=10)
