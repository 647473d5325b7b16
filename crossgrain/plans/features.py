"""Queries over features and scans (A, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.functions.frames import dense, percentile_rank
from crossgrain.operators import features as ft
from crossgrain.operators import metrics, pit
from crossgrain.plans.common import BUCKETS, average_rank_sql, bucketed_sql, out, scored, scored_sql, sql
from crossgrain.plans.registry import query
from crossgrain.sources import bars as src
from crossgrain.sources.bars import bars, bars_sql, table

W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"
R = "round(x, 6)"


def frame(fn: str, x: str, n: int, least: int | None = None, lag: int = 1) -> str:
    o = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n + lag - 1} PRECEDING AND {lag} PRECEDING)" if lag else f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    call = fn.replace("$", x)
    return f"CASE WHEN count({x}) {o} >= {least or n} THEN {call} {o} END"


@query("A1_scan_bars", sql(bars_sql(), select="SELECT symbol, date, round(open,6) open, round(high,6) high, round(low,6) low, round(close,6) AS close, round(volume,6) volume FROM b WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND symbol IN ('1','2','3','5','8')"))
def scan(spark, sf):
    return out(src.scan(bars(spark, sf), symbols=["1", "2", "3", "5", "8"], start="1995-01-01", end="1996-12-31"))


@query("A2_symbols", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem")
def symbols(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"))
    return src.symbols_of(rows)


@query("A5_canonical_tickers", "SELECT s_name AS raw, CASE WHEN upper(trim(s_name)) LIKE '^%' OR upper(trim(s_name)) LIKE '%.NS' THEN upper(trim(s_name)) ELSE upper(trim(s_name)) || '.NS' END AS ticker, upper(trim(s_name)) AS plain FROM supplier")
def tickers(spark, sf):
    t = table(spark, sf, "supplier").select(F.col("s_name").alias("raw")).withColumn("ticker", src.canonical(F.col("raw")))
    return t.withColumn("plain", src.plain_symbol(F.col("ticker")))


@query("A14_benchmark_series", sql(bars_sql(), select="SELECT date, round(close,6) AS close FROM b WHERE symbol = '1'"))
def benchmark(spark, sf):
    return out(src.scan(bars(spark, sf), symbols=["1"]).select("date", "close"))


ADJUSTED = """f AS (SELECT *, CASE WHEN date >= DATE '1995-06-01' + to_days(CAST(30 * (CAST(symbol AS INTEGER) % 40) AS INTEGER)) THEN 0.5 ELSE 1.0 END AS adj_factor FROM b),
 g AS (SELECT *, CASE WHEN adj_factor <> lag(adj_factor) OVER w AND CAST(symbol AS INTEGER) % 2 = 0 THEN 2.0 ELSE 0.0 END AS stock_splits, 0.0 AS dividends FROM f WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def adjusted(spark, sf):
    """Weekly bars with a factor that halves on a date of the symbol's own; even symbols state the split."""
    from crossgrain.functions.frames import own

    n = F.col("symbol").cast("int")
    day = F.date_add(F.lit("1995-06-01").cast("date"), 30 * (n % 40))
    b = bars(spark, sf).withColumn("adj_factor", F.when(F.col("date") >= day, 0.5).otherwise(1.0))
    moved = F.coalesce(F.col("adj_factor") != F.lag("adj_factor").over(own()), F.lit(False))
    return b.withColumns({"stock_splits": F.when(moved & (n % 2 == 0), 2.0).otherwise(0.0), "dividends": F.lit(0.0)})


@query("A3_normalized", """SELECT symbol, date, round(open,6) open, round(high,6) high, round(low,6) low, round(close,6) AS close, round(volume,6) volume, round(adj_factor,6) adj_factor FROM (
 SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice * f AS open, l_extendedprice * f AS high, l_extendedprice * f AS low, l_extendedprice * f AS close, l_quantity AS volume, f AS adj_factor,
 row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey DESC) AS n
 FROM (SELECT *, 1 - l_discount AS f FROM lineitem)) WHERE n = 1""")
def normalized(spark, sf):
    raw = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("Date"), F.col("l_extendedprice").alias("Last"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("Adj Close"), F.col("l_quantity").alias("VOL"), (F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("seq"))
    got = src.normalized(raw, symbol=F.col("l_suppkey").cast("string"), sequence="seq")
    return out(got.select("symbol", "date", "open", "high", "low", "close", "volume", "adj_factor"))


@query("A4_corporate_actions", sql(bars_sql(), ADJUSTED, select="""SELECT symbol, date, CASE WHEN stock_splits <> 0 THEN 'split' ELSE 'implied' END AS kind, round(CASE WHEN stock_splits <> 0 THEN stock_splits ELSE jump END, 6) AS value, stock_splits <> 0 AS stated, coalesce(abs(jump - 1) > 0.005, false) AS factor_moved
 FROM (SELECT *, adj_factor / lag(adj_factor) OVER w AS jump FROM g WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE stock_splits <> 0 OR abs(jump - 1) > 0.005"""))
def actions(spark, sf):
    return out(src.corporate_actions(adjusted(spark, sf)))


@query("W3_forward_returns", sql(bars_sql(), select=f"SELECT symbol, date, round(lead(close,1) OVER w/close-1,6) r1, round(lead(close,5) OVER w/close-1,6) r5 FROM b {W}"))
def forward(spark, sf):
    return out(bars(spark, sf).select("symbol", "date", ft.forward_return(1).alias("r1"), ft.forward_return(5).alias("r5")))


@query("W8_moving_averages", sql(bars_sql(), select=f"SELECT symbol, date, round({frame('avg($)', 'close', 20)},6) sma_20, round({frame('avg($)', 'close', 50)},6) sma_50, round({frame('avg($)', 'close', 200)},6) sma_200 FROM b"))
def moving_averages(spark, sf):
    return out(ft.with_features(bars(spark, sf), ["sma_20", "sma_50", "sma_200"]).select("symbol", "date", "sma_20", "sma_50", "sma_200"))


@query("W9_upper_channel", sql(bars_sql(), select=f"SELECT symbol, date, round({frame('max($)', 'high', 20)},6) donchian_upper_20 FROM b"))
def channel(spark, sf):
    return out(ft.with_features(bars(spark, sf), ["donchian_upper_20"]).select("symbol", "date", "donchian_upper_20"))


TR = f"t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM b {W})"


@query("W10_true_range", sql(bars_sql(), TR, select=f"SELECT symbol, date, round({frame('avg($)', 'tr', 14)},6) atr_14 FROM t"))
def atr(spark, sf):
    return out(ft.with_atr(bars(spark, sf)).select("symbol", "date", "atr_14"))


@query("W11_relative_strength", sql(bars_sql(), f"d AS (SELECT symbol, date, coalesce(lag(close,1) OVER w - lag(close,2) OVER w, 0.0) AS d FROM b {W}), e AS (SELECT symbol, date, {frame('avg($)', 'greatest(d, 0.0)', 14, lag=0)} AS up, {frame('avg($)', 'greatest(-d, 0.0)', 14, lag=0)} AS dn FROM d)", select="SELECT symbol, date, round(CASE WHEN dn = 0 THEN CASE WHEN up > 0 THEN 100.0 END ELSE 100 - 100 / (1 + up / dn) END, 6) AS rsi_14 FROM e"))
def rsi(spark, sf):
    return out(ft.with_rsi(bars(spark, sf)).select("symbol", "date", "rsi_14"))


def ema_sql(name: str, source: str, x: str, alpha: float) -> str:
    return f"""{name} AS (SELECT symbol, n, date, {x} AS e FROM {source} WHERE n = 1 UNION ALL
        SELECT s.symbol, s.n, s.date, CASE WHEN s.{x} IS NULL THEN r.e WHEN r.e IS NULL THEN s.{x} ELSE {alpha!r} * s.{x} + {1 - alpha!r} * r.e END FROM {source} s JOIN {name} r ON s.symbol = r.symbol AND s.n = r.n + 1)"""


@query("W12_macd", "WITH RECURSIVE " + ",".join([bars_sql(), f"s AS (SELECT symbol, date, row_number() OVER w AS n, lag(close) OVER w AS x FROM b {W})", ema_sql("fast", "s", "x", 2 / 13), ema_sql("slow", "s", "x", 2 / 27)]) + " SELECT symbol, date, round(f.e - s.e, 6) AS macd FROM fast f JOIN slow s USING (symbol, date)")
def macd(spark, sf):
    return out(ft.with_macd(bars(spark, sf)).select("symbol", "date", "macd"))


@query("W13_adx")
def adx(spark, sf):
    return out(ft.with_adx(bars(spark, sf)).select("symbol", "date", "adx", "adx_lag"))


@query("W14_percent_b", sql(bars_sql(), f"m AS (SELECT symbol, date, lag(close) OVER w AS x, {frame('avg($)', 'close', 20)} AS mid, {frame('stddev_samp($)', 'close', 20)} AS sd FROM b {W})", select="SELECT symbol, date, round((x - (mid - 2 * sd)) / nullif(4 * sd, 0), 6) AS bollinger_pct_b FROM m"))
def percent_b(spark, sf):
    return out(ft.with_percent_b(bars(spark, sf)).select("symbol", "date", "bollinger_pct_b"))


RET = f"r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close * volume AS v FROM b {W})"


@query("W15_returns_and_activity", sql(bars_sql(), RET, select=f"""SELECT symbol, date, round(lag(close,1) OVER w/lag(close,2) OVER w-1,6) return_1d, round(lag(close,1) OVER w/lag(close,6) OVER w-1,6) return_5d, round(lag(close,1) OVER w/lag(close,22) OVER w-1,6) return_21d,
 round(lag(close,21) OVER w/lag(close,210) OVER w-1,6) mom_9m_skip1m, round({frame('avg($)', 'volume', 5)} / nullif({frame('avg($)', 'volume', 20)}, 0),6) volume_ratio_20, round({frame('stddev_samp($)', 'ret', 60)} * sqrt(252.0),6) realized_vol_60,
 round({frame('median($)', 'v', 60, 20)},6) traded_value_60 FROM r {W}"""))
def returns(spark, sf):
    names = ["return_1d", "return_5d", "return_21d", "mom_9m_skip1m", "volume_ratio_20"]
    d = ft.with_traded_value(ft.with_volatility(ft.with_features(bars(spark, sf), names), 60))
    return out(d.select("symbol", "date", *names, "realized_vol_60", "traded_value_60"))


BANDS_SQL = " OR ".join(f"abs(abs(m) - {b}) <= {min(0.004, b * 0.25)!r}" for b in ft.BANDS) + f" OR abs(m) >= {0.20 - 0.004!r}"
FLAGS = f"""m AS (SELECT *, close / lag(close) OVER w - 1 AS m, close - lag(close) OVER w AS c FROM b {W}),
 fl AS (SELECT symbol, date, close, volume, coalesce(abs(high - low) <= 1e-9 AND ({BANDS_SQL}), false) AS locked, coalesce(abs(high - close) <= 1e-9 AND m > 0 AND ({BANDS_SQL}), false) AS trapped,
 coalesce(abs(low - close) <= 1e-9 AND m < 0 AND ({BANDS_SQL}), false) AS locked_down, coalesce(abs(c) <= 1e-12, false) AS zero_return FROM m)"""


@query("W16_limit_flags", sql(bars_sql(), FLAGS, select="SELECT symbol, date, locked, trapped, locked_down, zero_return," + ",".join(f"lag({c}) OVER w AS {c}_last, round({frame('avg($)', f'CAST({c} AS DOUBLE)', 60, 20)},6) AS {c}_share" for c in ("locked", "trapped", "locked_down", "zero_return")) + f" FROM fl {W}"))
def limit_flags(spark, sf):
    flags = ["locked", "trapped", "locked_down", "zero_return"]
    d = ft.with_limit_shares(ft.with_limit_flags(bars(spark, sf)))
    return out(d.select("symbol", "date", *flags, *[f"{c}_{k}" for c in flags for k in ("last", "share")]))


@query("W1_percentile_rank", sql(scored_sql(), select=f"SELECT date, symbol, round({average_rank_sql('score')} / (count(*) OVER (PARTITION BY date) + 1), 6) AS pct FROM p"))
def percentile(spark, sf):
    return out(scored(spark, sf).select("date", "symbol", percentile_rank("score").alias("pct")))


@query("W2_buckets", sql(scored_sql(), bucketed_sql(), select="SELECT date, symbol, bucket FROM q"))
def buckets(spark, sf):
    return metrics.bucketed(scored(spark, sf), BUCKETS).select("date", "symbol", "bucket")


@query("W4_relative_labels", sql(scored_sql(), select=f"SELECT date, symbol, round(forward_return - avg(forward_return) OVER (PARTITION BY date), 6) AS demeaned, round(2 * {average_rank_sql('forward_return')} / (count(*) OVER (PARTITION BY date) + 1) - 1, 6) AS ranked FROM p QUALIFY count(*) OVER (PARTITION BY date) >= 5"))
def labels(spark, sf):
    from crossgrain.functions.frames import across

    w = across("date")
    d = scored(spark, sf).withColumns({"demeaned": F.col("forward_return") - F.avg("forward_return").over(w), "ranked": 2 * percentile_rank("forward_return") - 1, "n": F.count(F.lit(1)).over(w)})
    return out(d.where("n >= 5").select("date", "symbol", "demeaned", "ranked"))


@query("W5_zscores", sql(scored_sql(), select="SELECT date, symbol, round(coalesce(least(greatest(CASE WHEN stddev_pop(score) OVER d > 0 THEN (score - avg(score) OVER d) / stddev_pop(score) OVER d ELSE 0 END, -10), 10), 0), 6) AS score_z FROM p QUALIFY count(*) OVER (PARTITION BY date) >= 5 WINDOW d AS (PARTITION BY date)".replace("QUALIFY count(*) OVER (PARTITION BY date) >= 5 WINDOW d AS (PARTITION BY date)", "WINDOW d AS (PARTITION BY date) QUALIFY count(*) OVER (PARTITION BY date) >= 5")))
def zscores(spark, sf):
    return out(pit.zscored(scored(spark, sf), ["score"]).select("date", "symbol", "score_z"))


@query("W7_past_zscore", sql(bars_sql(), select="SELECT symbol, date, round((close - avg(close) OVER f) / (stddev_samp(close) OVER f + 1e-8), 6) AS close_z FROM b WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"))
def past_z(spark, sf):
    return out(ft.past_zscore(bars(spark, sf), "close").select("symbol", "date", "close_z"))


@query("W24_latest_values", sql(bars_sql(), f"k AS (SELECT symbol, date, {frame('avg($)', 'close', 20)} AS v FROM b)", select="SELECT symbol, last(date ORDER BY date) AS date, round(last(v ORDER BY date), 6) AS sma_20 FROM k WHERE v IS NOT NULL GROUP BY symbol"))
def latest(spark, sf):
    d = ft.with_features(bars(spark, sf), ["sma_20"]).where("sma_20 is not null")
    return out(d.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("sma_20", "date").alias("sma_20")))


@query("W32_intraday_overnight", sql(bars_sql(), f"k AS (SELECT symbol, date, close / nullif(open,0) - 1 AS intraday, open / nullif(lag(close) OVER w,0) - 1 AS overnight FROM b {W})", select="SELECT symbol, date, round(intraday,6) intraday, round(overnight,6) overnight FROM k WHERE intraday IS NOT NULL AND overnight IS NOT NULL"))
def legs(spark, sf):
    return out(ft.intraday_and_overnight(bars(spark, sf)).select("symbol", "date", "intraday", "overnight"))


@query("W38_dense_grid", sql(bars_sql("month"), select="SELECT s.symbol, d.date, round(b.close, 6) AS close FROM (SELECT DISTINCT symbol FROM b) s CROSS JOIN (SELECT DISTINCT date FROM b) d LEFT JOIN b ON b.symbol = s.symbol AND b.date = d.date"))
def grid(spark, sf):
    return out(dense(bars(spark, sf, "month"), ["close"]).select("symbol", "date", "close"))


@query("P23_warmup", sql(bars_sql(), f"k AS (SELECT symbol, date, close, row_number() OVER w AS n FROM b {W})", select=f"SELECT symbol, date, round(close,6) AS close FROM k WHERE n > {ft.warmup_rows(['sma_50', 'return_21d'])}"))
def warmed(spark, sf):
    from crossgrain.functions.frames import own

    d = bars(spark, sf).withColumn("n", F.row_number().over(own())).where(F.col("n") > ft.warmup_rows(["sma_50", "return_21d"]))
    return out(d.select("symbol", "date", "close"))


@query("U2_calendar", sql(bars_sql(), select="SELECT DISTINCT date FROM b"))
def calendar(spark, sf):
    return bars(spark, sf).select("date").distinct()


@query("U3_common_dates", sql(bars_sql(), select="SELECT date FROM b WHERE symbol = '1' INTERSECT SELECT date FROM b WHERE symbol = '2'"))
def common_dates(spark, sf):
    b = bars(spark, sf)
    return b.where("symbol = '1'").select("date").intersect(b.where("symbol = '2'").select("date"))


@query("U4_missing_dates", sql(bars_sql(), select="SELECT DISTINCT date FROM b WHERE date NOT IN (SELECT date FROM b WHERE symbol = '1')"))
def missing_dates(spark, sf):
    b = bars(spark, sf)
    return b.select("date").distinct().join(b.where("symbol = '1'").select("date"), "date", "left_anti")


