"""Queries that turn rankings into signals and combine them (P6, K, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding
from crossgrain.functions import expressions as X
from crossgrain.operators import features as ft
from crossgrain.operators import signals as s
from crossgrain.plans.common import sql
from crossgrain.plans.features import FLAGS, TR, W, frame
from crossgrain.plans.pit import SECTORS, sectors
from crossgrain.plans.registry import query
from crossgrain.sources.bars import bars, bars_sql

BUY, SELL = X.cost_per_side("BUY"), X.cost_per_side("SELL")

FEATURES_SQL = f"""{FLAGS}, {TR}, ft AS (SELECT t.symbol, t.date, t.close, {frame('avg($)', 'tr', 14)} AS atr FROM t),
 rt AS (SELECT symbol, date, close / lag(close) OVER w - 1 AS ret, close * volume AS v, lag(close, 4) OVER w / lag(close, 30) OVER w - 1 AS mom, lag(close,1) OVER w / lag(close,5) OVER w - 1 AS rev FROM b {W}),
 rv AS (SELECT symbol, date, mom, rev, {frame('stddev_samp($)', 'ret', 26)} * sqrt(52.0) AS vol, {frame('median($)', 'v', 60, 20)} AS traded_value FROM rt),
 lf AS (SELECT symbol, date, lag(locked) OVER w AS locked_last, lag(trapped) OVER w AS trapped_last, {frame('avg($)', 'CAST(locked AS DOUBLE)', 60, 20)} AS locked_share, {frame('avg($)', 'CAST(trapped AS DOUBLE)', 60, 20)} AS trapped_share, {frame('avg($)', 'CAST(zero_return AS DOUBLE)', 60, 20)} AS zero_share FROM fl {W}),
 pn AS (SELECT symbol, date, close, atr, mom, rev, vol, CASE WHEN traded_value < 5000000.0 AND CAST(symbol AS INTEGER) % 7 = 0 THEN 'traded_value' WHEN zero_share > 0.3 THEN 'zero_return' WHEN locked_share > 0.1 THEN 'locked' WHEN trapped_share > 0.05 THEN 'operator_trap' WHEN locked_last THEN 'locked_today' WHEN trapped_last THEN 'trapped_today' END AS reject_reason FROM ft JOIN rv USING (symbol, date) JOIN lf USING (symbol, date))"""


#: Monthly bars that close at their typical price: a close that is one trade moves by a limit nearly every time.
TYPICAL = f"""{bars_sql('month', 'b0')}, b AS (SELECT symbol, date, open, high, low, (high + low + close) / 3 AS close, volume FROM b0)"""


def typical_bars(spark, sf) -> DataFrame:
    return bars(spark, sf, "month").withColumn("close", (F.col("high") + F.col("low") + F.col("close")) / 3)


def panel(spark, sf) -> DataFrame:
    return screened(typical_bars(spark, sf))


def screened(b: DataFrame) -> DataFrame:
    """Features and screens of every bar; the traded value counts for every seventh symbol only."""
    b = ft.with_limit_shares(ft.with_limit_flags(ft.with_atr(b)))
    b = ft.with_traded_value(ft.with_volatility(b, 26, 52))
    b = b.withColumns({"mom": ft.momentum(26, 4), "rev": ft.change("close", 4, lag=1)})
    d = b.withColumns({"traded_value": F.when(F.col("symbol").cast("int") % 7 == 0, F.col("traded_value_60")), "atr": F.col("atr_14"), "volatility": F.col("realized_vol_26")})
    return d.withColumn("reject_reason", s.reject_reason()).withColumns({"exposure": F.lit(1.0), "blocked": F.month("date") == 10})


def select_sql(metric: str, high: bool, top: float = 0.2) -> str:
    order = "DESC" if high else "ASC"
    return f"""x AS (SELECT *, {metric} AS metric, reject_reason IS NULL AND {metric} IS NOT NULL AS fit, month(date) = 10 AS blocked FROM pn),
 y AS (SELECT *, count(*) OVER (PARTITION BY date, fit) AS n, row_number() OVER (PARTITION BY date, fit ORDER BY metric {order} {'NULLS LAST' if high else 'NULLS FIRST'}, symbol) AS rank, round(CASE WHEN atr > 0 THEN greatest(close - 1.5 * atr, 0.0) ELSE close * 0.98 END, 2) AS stop, round(CASE WHEN atr > 0 THEN close + 2.0 * atr ELSE close * 1.03 END, 2) AS target FROM x),
 z AS (SELECT *, fit AND n >= 5 AS ranked, target * (1 - {SELL!r}) - close * (1 + {BUY!r}) AS reward, close * (1 + {BUY!r}) - stop * (1 - {SELL!r}) AS risk, rank <= greatest(ceil(n * {top}), 1) AS in_top FROM y),
 sg AS (SELECT *, CASE WHEN stop < close AND reward > 0 AND risk > 0 THEN reward / risk ELSE 0 END AS rr FROM z),
 so AS (SELECT date, symbol, metric, CASE WHEN NOT ranked OR NOT stop < close THEN 'AVOID' WHEN in_top AND close >= 10.0 AND rr > 0 AND NOT blocked THEN 'BUY' WHEN in_top THEN 'WATCH' ELSE 'AVOID' END AS signal,
  CASE WHEN ranked THEN round((1 - CASE WHEN n > 1 THEN (rank - 1) / (n - 1) ELSE 0 END) * 100, 2) ELSE 0 END AS score, close AS entry, CASE WHEN ranked THEN stop ELSE 0 END AS stop, CASE WHEN ranked THEN target ELSE 0 END AS target, CASE WHEN ranked THEN rr ELSE 0 END AS reward_risk, round(coalesce(CASE WHEN vol > 0 THEN least(greatest(3.0 / vol, 0.25), 1.0) END, 1.0), 4) AS scale, reject_reason FROM sg)"""


SIGNAL_COLUMNS = "date, symbol, signal, round(score,2) score, round(entry,4) entry, round(reward_risk,4) reward_risk, CASE WHEN signal = 'BUY' THEN scale ELSE 0 END AS position_scale, reject_reason"


def selected(spark, sf, metric: str, high: bool) -> DataFrame:
    return s.rank_and_select(panel(spark, sf).withColumn("metric", F.col(metric)), top=0.2, high_is_good=high, min_universe=5, volatility_target=3.0)


def shown(d: DataFrame) -> DataFrame:
    return d.select("date", "symbol", "signal", rounding("score", 2).alias("score"), rounding("entry", 4).alias("entry"), "reward_risk", "position_scale", "reject_reason")


@query("P6_tradability", sql(bars_sql(), FEATURES_SQL, select="SELECT date, symbol, reject_reason FROM pn"))
def tradability(spark, sf):
    return screened(bars(spark, sf)).select("date", "symbol", "reject_reason")


@query("K1_rank_and_select", sql(TYPICAL, FEATURES_SQL, select_sql("mom", True), select="SELECT signal, count(*) AS rows, round(avg(score), 4) AS mean_score, round(avg(stop),3) mean_stop, round(avg(target),3) mean_target FROM so GROUP BY signal"))
def k1(spark, sf):
    d = selected(spark, sf, "mom", True).groupBy("signal").agg(F.count(F.lit(1)).alias("rows"), rounding(F.avg("score"), 4).alias("mean_score"), rounding(F.avg("stop"), 3).alias("mean_stop"), rounding(F.avg("target"), 3).alias("mean_target"))
    return d


@query("K2_momentum_signals", sql(TYPICAL, FEATURES_SQL, select_sql("mom", True), select=f"SELECT {SIGNAL_COLUMNS} FROM so"))
def k2(spark, sf):
    return shown(selected(spark, sf, "mom", True))


@query("K3_reversal_signals", sql(TYPICAL, FEATURES_SQL, select_sql("rev", False), select=f"SELECT {SIGNAL_COLUMNS} FROM so"))
def k3(spark, sf):
    return shown(selected(spark, sf, "rev", False))


@query("K4_low_volatility_signals", sql(TYPICAL, FEATURES_SQL, select_sql("vol", False), select=f"SELECT {SIGNAL_COLUMNS} FROM so"))
def k4(spark, sf):
    return shown(selected(spark, sf, "volatility", False))


RULES = f"""rb AS (SELECT *, {frame('avg($)', 'close', 20)} AS sf, {frame('avg($)', 'close', 50)} AS ss, {frame('max($)', 'high', 20)} AS up, {frame('avg($)', 'volume', 5)} / nullif({frame('avg($)', 'volume', 20)}, 0) AS vr, {frame('avg($)', 'tr', 14)} AS atr, (CAST(symbol AS INTEGER) * 37 % 100) / 100.0 AS probability FROM t),
 rc AS (SELECT *, CASE WHEN sf IS NOT NULL AND ss IS NOT NULL THEN CASE WHEN close > sf AND sf > ss THEN 1.0 WHEN close > ss THEN 0.5 ELSE 0.0 END END AS trend, CASE WHEN up IS NOT NULL THEN CASE WHEN close > up THEN 1.0 ELSE 0.0 END END AS breakout, CASE WHEN vr IS NOT NULL THEN least(greatest(vr / 2, 0), 1) END AS vol FROM rb),
 rs AS (SELECT *, round(100 * (coalesce(trend,0)*40 + coalesce(breakout,0)*30 + coalesce(vol,0)*15 + probability*15) / (CASE WHEN trend IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN breakout IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN vol IS NOT NULL THEN 15 ELSE 0 END + 15), 2) AS score, round(CASE WHEN atr > 0 THEN greatest(close - 1.5 * atr, 0.0) ELSE close * 0.98 END, 2) AS stop, round(CASE WHEN atr > 0 THEN close + 2.0 * atr ELSE close * 1.03 END, 2) AS target FROM rc),
 rr AS (SELECT *, target * (1 - {SELL!r}) - close * (1 + {BUY!r}) AS reward, close * (1 + {BUY!r}) - stop * (1 - {SELL!r}) AS risk FROM rs),
 ru AS (SELECT *, CASE WHEN breakout >= 1 THEN 'Breakout' WHEN trend >= 1 THEN 'Trend' WHEN vol >= 0.75 THEN 'Volume' WHEN probability >= 0.55 THEN 'Probability' ELSE 'None' END AS trigger, CASE WHEN score >= 60 AND probability >= 0.55 AND CASE WHEN reward > 0 AND risk > 0 THEN reward / risk ELSE 0 END >= 1.0 AND close >= 10 THEN 'BUY' WHEN score >= 45 THEN 'WATCH' ELSE 'AVOID' END AS signal FROM rr)"""


def ruled(b: DataFrame) -> DataFrame:
    b = ft.with_atr(b).withColumns({"sma_fast": ft.moving_average(20), "sma_slow": ft.moving_average(50), "upper": ft.upper_channel(20), "volume_ratio": ft.FEATURES["volume_ratio_20"](), "probability": (F.col("symbol").cast("int") * 37 % 100) / 100.0})
    return s.rule_based(b.withColumn("atr", F.col("atr_14")))


@query("K8_rule_based", sql(bars_sql(), TR, RULES, select="SELECT date, symbol, round(score,1) score, trigger, signal FROM ru"))
def k8(spark, sf):
    return ruled(bars(spark, sf)).select("date", "symbol", rounding("score", 1).alias("score"), "trigger", "signal")


VOTES = f"{FEATURES_SQL}, {select_sql('mom', True)}, {RULES.replace('rb AS (SELECT *,', 'rb AS (SELECT t.*,')}, vt AS (SELECT date, symbol, 'momentum' AS model, signal, 2.0 AS weight, score FROM so UNION ALL SELECT date, symbol, 'rules', signal, 1.0, score FROM ru)"


def votes(spark, sf) -> DataFrame:
    a = selected(spark, sf, "mom", True).select("date", "symbol", F.lit("momentum").alias("model"), "signal", F.lit(2.0).alias("weight"), "score")
    return a.unionByName(ruled(typical_bars(spark, sf)).select("date", "symbol", F.lit("rules").alias("model"), "signal", F.lit(1.0).alias("weight"), "score"))


STRENGTH_SQL = "CASE signal WHEN 'BUY' THEN 1.0 WHEN 'WATCH' THEN 0.3 WHEN 'HOLD' THEN 0.0 WHEN 'AVOID' THEN -0.3 WHEN 'SELL' THEN -1.0 ELSE 0.0 END"


@query("E2_weighted_blend", sql(TYPICAL, VOTES, select=f"SELECT date, symbol, round(st,4) AS strength, CASE WHEN round(st,9) >= 0.6 THEN 'BUY' WHEN round(st,9) >= 0.2 THEN 'WATCH' WHEN round(st,9) <= -0.6 THEN 'SELL' ELSE 'AVOID' END AS signal FROM (SELECT date, symbol, sum({STRENGTH_SQL} * weight) / sum(weight) AS st FROM vt GROUP BY ALL)"))
def e2(spark, sf):
    return s.blended(votes(spark, sf)).select("date", "symbol", rounding("strength", 4).alias("strength"), "signal")


@query("E3_votes", sql(TYPICAL, VOTES, select="SELECT date, symbol, buys, models, CASE WHEN buys * 2 > models THEN 'BUY' WHEN buys > 0 THEN 'WATCH' ELSE 'AVOID' END AS signal, buys = models AS unanimous FROM (SELECT date, symbol, count(*) FILTER (WHERE signal = 'BUY') AS buys, count(*) AS models FROM vt GROUP BY ALL)"))
def e3(spark, sf):
    d = s.voted(votes(spark, sf))
    return d.withColumn("unanimous", F.col("buys") == F.col("models")).select("date", "symbol", "buys", "models", "signal", "unanimous")


@query("E4_permitted_members", sql(TYPICAL, VOTES, select="SELECT date, symbol, model, CASE WHEN month(date) <= 6 THEN 'calm' ELSE 'wild' END AS regime FROM vt WHERE month(date) > 6 OR model = 'rules'"))
def e4(spark, sf):
    v = votes(spark, sf)
    regimes = v.select("date").distinct().withColumn("regime", F.when(F.month("date") <= 6, "calm").otherwise("wild"))
    allowed = spark.createDataFrame([("calm", "rules")], "regime string, model string")
    return s.permitted(v, regimes, allowed).select("date", "symbol", "model", "regime")


@query("E5_anchor_rows", sql(TYPICAL, VOTES, select="SELECT date, symbol, round(max(score), 1) AS score, first(model ORDER BY score DESC, model) AS anchor FROM vt GROUP BY ALL"))
def e5(spark, sf):
    v = votes(spark, sf)
    best = F.min_by("model", F.struct((-F.col("score")).alias("k"), "model"))
    return v.groupBy("date", "symbol").agg(rounding(F.max("score"), 1).alias("score"), best.alias("anchor"))


VERDICTS = "vd AS (SELECT date, symbol, model, signal AS action, score / 100 * CASE WHEN CAST(symbol AS INTEGER) % 3 = 0 THEN 0.75 ELSE 1.0 END AS confidence, score - CASE WHEN CAST(symbol AS INTEGER) % 13 = 5 THEN 120 ELSE 50 END AS ev, month(date) <> 3 OR (model = 'rules' AND CAST(symbol AS INTEGER) % 2 = 0) AS rc, CAST(symbol AS INTEGER) % 11 <> 0 AS lp FROM vt)"


@query(
    "E1_arbitration",
    sql(TYPICAL, VOTES, VERDICTS, """va AS (SELECT date, symbol, count(*) FILTER (WHERE action = 'BUY' AND rc) AS buys, count(*) FILTER (WHERE action IN ('SELL','AVOID')) AS against, bool_and(lp) AS liquid, bool_or(rc) AS fits, max(confidence) FILTER (WHERE action = 'BUY') AS best, sum(confidence * ev) FILTER (WHERE action = 'BUY') / nullif(sum(confidence) FILTER (WHERE action = 'BUY'), 0) AS ev FROM vd GROUP BY ALL),
 vr AS (SELECT *, CASE WHEN NOT liquid THEN 'liquidity' WHEN NOT fits THEN 'regime' WHEN buys = 0 THEN 'no_buys' WHEN against >= buys THEN 'conflict' WHEN ev <= 0 THEN 'expected_value' WHEN best >= 0.8 THEN 'strong' WHEN buys >= 2 THEN 'consensus' ELSE 'weak' END AS reason FROM va)""",
        select="SELECT date, symbol, buys, against, reason, reason IN ('strong','consensus') AS fires FROM vr"),
)
def e1(spark, sf):
    k = F.col("symbol").cast("int")
    v = votes(spark, sf).select(
        "date", "symbol", "model", F.col("signal").alias("action"),
        (F.col("score") / 100 * F.when(k % 3 == 0, 0.75).otherwise(1.0)).alias("confidence"),
        (F.col("score") - F.when(k % 13 == 5, 120).otherwise(50)).alias("ev"),
        ((F.month("date") != 3) | ((F.col("model") == "rules") & (k % 2 == 0))).alias("regime_compatible"),
        (k % 11 != 0).alias("liquidity_pass"),
    )
    return s.arbitrated(v).select("date", "symbol", "buys", "against", "reason", "fires")


@query("K11_sector_order", sql(TYPICAL, FEATURES_SQL, select_sql("mom", True), SECTORS, """k AS (SELECT so.date, so.symbol, coalesce(sector, 'UNKNOWN') AS sector, signal, score, CAST(100 + score AS DOUBLE) AS value FROM so LEFT JOIN sc ON sc.symbol = so.symbol WHERE signal = 'BUY'),
 kb AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY date, sector ORDER BY score DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)""", select="SELECT date, symbol, sector, round(least(value, greatest(250 - before, 0)), 4) AS taken, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place FROM kb"))
def k11(spark, sf):
    from crossgrain.operators.pit import sectors_of

    d = sectors_of(selected(spark, sf, "mom", True).where("signal = 'BUY'"), sectors(spark, sf)).withColumn("value", 100 + F.col("score"))
    return s.in_sector_order(d, 250.0).select("date", "symbol", "sector", rounding("taken", 4).alias("taken"), F.col("place").cast("long").alias("place"))


