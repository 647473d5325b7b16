"""Queries over trials, pairs, recommendations and models (P4, J10, J15, G24, G26, G41, G46, W39, K7, K14, M4, M9), files (A7-A13), lags (W23) and streams."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.frames import across, change, full, rounding
from crossgrain.operators import books, features, grouped, market, metrics, pit, studies
from crossgrain.plans.allocation import W29
from crossgrain.plans.books import CURVES, curves
from crossgrain.plans.common import bucketed_sql, ic_sql, out, scored, scored_sql, sql
from crossgrain.plans.evaluation import HORIZONS, MARKET
from crossgrain.plans.features import frame
from crossgrain.plans.grouped import WINDOWS, cdf_sql, quantile_sql, windows
from crossgrain.plans.market import top_by, top_sql
from crossgrain.plans.pit import FACTS, FLOATS, SECTORS, facts, floats, sectors
from crossgrain.plans.quality import DIRTY, dirty
from crossgrain.plans.registry import query
from crossgrain.plans.signals import FEATURES_SQL, TYPICAL, select_sql, selected
from crossgrain.sources import files
from crossgrain.sources.bars import BAR, bars, bars_sql, table, write_bars
from crossgrain.streaming import bars as streaming


@query("P4_seeded_symbols")
def p4(spark, sf):
    """No SQL: another engine has no such hash; a test holds that the draw depends on seed and purpose alone."""
    symbols = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"))
    return studies.seeded_symbols(symbols, 5, seed=7, purpose="training")


# ---- pairs ---------------------------------------------------------------------------------------

PAIRS = """lg AS (SELECT symbol, date, ln(close) AS p FROM b WHERE date < DATE '1997-01-01'), fl AS (SELECT symbol FROM lg GROUP BY symbol HAVING count(*) = (SELECT count(DISTINCT date) FROM lg)),
 lf AS (SELECT lg.* FROM lg JOIN fl USING (symbol)), pp AS (SELECT x.symbol AS a, y.symbol AS b, date, x.p AS x, y.p AS y FROM lf x JOIN lf y USING (date) WHERE x.symbol < y.symbol),
 hg AS (SELECT a, b, sum(x * y) / sum(y * y) AS hedge FROM pp GROUP BY ALL), sp AS (SELECT a, b, hedge, date, x - hedge * y AS s FROM pp JOIN hg USING (a, b)),
 df AS (SELECT *, lag(s) OVER w AS s0, s - lag(s) OVER w AS ds FROM sp WINDOW w AS (PARTITION BY a, b ORDER BY date)),
 rg AS (SELECT a, b, any_value(hedge) AS hedge, avg(s) AS m, stddev_samp(s) AS sd, count(*) AS n, regr_sxx(ds, s0) AS sxx, regr_sxy(ds, s0) AS sxy, regr_syy(ds, s0) AS syy FROM df GROUP BY a, b),
 pt AS (SELECT a, b, hedge, m, sd, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / ((n - 3) * sxx)) AS t FROM rg)"""


def formation(spark, sf) -> DataFrame:
    """The months in which pairs are formed; they are traded from 1997 on."""
    return bars(spark, sf, "month").where("date < date'1997-01-01'")


@query("J10_pairs", sql(bars_sql("month"), PAIRS, select="SELECT a, b, round(hedge, 6) AS hedge, round(t, 4) AS t, round(m, 6) AS spread_mean, round(sd, 6) AS spread_std FROM pt"))
def j10(spark, sf):
    d = market.pair_tests(formation(spark, sf))
    return d.select("a", "b", rounding("hedge", 6).alias("hedge"), rounding("t", 4).alias("t"), rounding("spread_mean", 6).alias("spread_mean"), rounding("spread_std", 6).alias("spread_std"))


CHEAP = """np AS (SELECT * FROM pt WHERE sd > 0 ORDER BY floor(t * 1e6 + 0.5), a, b LIMIT 50), ln AS (SELECT symbol, date, ln(close) AS p FROM b WHERE date >= DATE '1997-01-01'),
 zz AS (SELECT x.date, np.a, np.b, (x.p - hedge * y.p - m) / sd AS z FROM np JOIN ln x ON x.symbol = np.a JOIN ln y ON y.symbol = np.b AND y.date = x.date),
 ch AS (SELECT date, symbol, avg(c) AS cheapness, count(*) AS pairs FROM (SELECT date, a AS symbol, -z AS c FROM zz UNION ALL SELECT date, b, z FROM zz) GROUP BY ALL)"""


def cheapness(spark, sf) -> DataFrame:
    pairs = studies.nearest_pairs(market.pair_tests(formation(spark, sf), nearest=50))
    return studies.pair_scores(bars(spark, sf, "month").where("date >= date'1997-01-01'"), pairs)


@query("M4_pair_cheapness", sql(bars_sql("month"), PAIRS, CHEAP, select="SELECT date, symbol, round(cheapness, 5) AS cheapness, pairs FROM ch"))
def m4(spark, sf):
    return cheapness(spark, sf).select("date", "symbol", rounding("cheapness", 5).alias("cheapness"), "pairs")


@query("K7_cheap_leg_picks", sql(bars_sql("month"), PAIRS, CHEAP, select=top_sql("ch", "cheapness", True)))
def k7(spark, sf):
    return top_by(cheapness(spark, sf), "cheapness", True)


# ---- trials --------------------------------------------------------------------------------------


def nation_returns(spark, sf) -> DataFrame:
    """(trial, date, r): the mean of each nation's suppliers' clipped monthly returns."""
    m = bars(spark, sf, "month").select("symbol", "date", change("close", 1).alias("ret")).where("ret is not null")
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("n_name").alias("trial"))
    return m.join(s, "symbol").groupBy("trial", "date").agg(F.avg(F.least(F.greatest("ret", F.lit(-0.2)), F.lit(0.2))).alias("r"))


SPLITS = "sd AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {b}, {b in near})" for k, near in ((k, {b for _, b in g}) for k, g in groupby(studies.halves(6), key=lambda x: x[0])) for b in range(6)) + ") t(split, block, near))"
CSCV = f"""db AS (SELECT date, CAST(floor((row_number() OVER (ORDER BY date) - 1) * 6.0 / count(*) OVER ()) AS INTEGER) AS block FROM (SELECT DISTINCT date FROM nr)), {SPLITS},
 cs AS (SELECT split, book_id AS trial, avg(r) FILTER (WHERE near) / stddev_samp(r) FILTER (WHERE near) AS n, avg(r) FILTER (WHERE NOT near) / stddev_samp(r) FILTER (WHERE NOT near) AS f FROM nr JOIN db USING (date) JOIN sd USING (block) GROUP BY ALL),
 cb AS (SELECT split, trial AS best, f AS bf, count(*) OVER (PARTITION BY split) AS trials FROM cs QUALIFY row_number() OVER (PARTITION BY split ORDER BY n DESC, trial DESC) = 1),
 cr AS (SELECT split, any_value(best) AS best, count(*) FILTER (WHERE f <= bf) AS rank, count(*) AS trials FROM cs JOIN cb USING (split) GROUP BY split)"""


@query("G26_overfitting", sql(bars_sql("month"), CURVES, CSCV, select="SELECT CAST(split AS INTEGER) AS split, best, rank, round(ln((rank / (trials + 1.0)) / (1 - rank / (trials + 1.0))), 6) AS logit FROM cr"))
def g26(spark, sf):
    return out(studies.overfitting(nation_returns(spark, sf), blocks=6))


DSR = f"""mo AS (SELECT book_id AS trial, count(*) AS n, avg(r) / stddev_samp(r) AS s, avg(pow(r - m, 3)) / pow(stddev_pop(r), 3) AS skew, avg(pow(r - m, 4)) / pow(stddev_pop(r), 4) AS kurt FROM (SELECT *, avg(r) OVER (PARTITION BY book_id) AS m FROM nr) GROUP BY book_id),
 q1 AS (SELECT 1 - 1.0 / count(*) AS pa, 1 - 1.0 / (count(*) * {studies.e!r}) AS pb, var_samp(s) AS v FROM mo), q2 AS (SELECT sqrt(v) * ((1 - {studies.EULER!r}) * ({quantile_sql('pa')}) + {studies.EULER!r} * ({quantile_sql('pb')})) AS eb FROM q1),
 ds AS (SELECT trial, s, eb, s / sqrt(greatest(1 - skew * s + (kurt - 1) / 4 * s * s, 1e-12) / (n - 1)) AS z0, (s - eb) / sqrt(greatest(1 - skew * s + (kurt - 1) / 4 * s * s, 1e-12) / (n - 1)) AS z1 FROM mo, q2)"""


@query("G24_deflated_sharpe", sql(bars_sql("month"), CURVES, DSR, select=f"SELECT trial, round(s, 6) AS sharpe, round(eb, 6) AS expected_best, round({cdf_sql('z0')}, 6) AS psr, round({cdf_sql('z1')}, 6) AS dsr FROM ds"))
def g24(spark, sf):
    return out(studies.deflated(books.moments(nation_returns(spark, sf), "r", "trial")).select("trial", "sharpe", "expected_best", "psr", "dsr"))


# ---- panels --------------------------------------------------------------------------------------


@query("J15_labels", sql(scored_sql(horizons=HORIZONS), select="SELECT date, symbol, " + ", ".join(f"round(forward_return_{h}, 6) AS forward_return_{h}" for h in HORIZONS) + " FROM p"))
def j15(spark, sf):
    return out(scored(spark, sf, horizons=HORIZONS).select("date", "symbol", *[f"forward_return_{h}" for h in HORIZONS]))


@query("W39_strided_volatility", sql(bars_sql(), f"r AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM b), v AS (SELECT symbol, date, {frame('stddev_samp($)', 'r', 25, 20)} AS v FROM r)", select="SELECT symbol, date, round(v, 6) AS volatility FROM v"))
def w39(spark, sf):
    """A window of 126 sessions on bars that hold five each."""
    rows = studies.strided_rows(126, 5)
    return out(bars(spark, sf).withColumn("_r", change("close", 1)).select("symbol", "date", full(F.stddev_samp, "_r", rows, least=20).alias("volatility")))


@query("G41_risk_over_time", sql(scored_sql(), bucketed_sql(), WINDOWS, "cx AS (SELECT date, 2 * (s + share * (r * g - s)) AS c, 0 AS one FROM pv JOIN sh USING (date) UNION ALL SELECT date, v, 1 FROM vr), ck AS (SELECT date, sum(one) AS names, sqrt(greatest(sum(c), 0)) / sum(one) AS vol FROM cx GROUP BY date)", select="SELECT count(*) AS dates, round(avg(names), 4) AS mean_names, round(avg(vol), 6) AS mean_volatility, round(min(vol), 6) AS least, round(max(vol), 6) AS most, round(arg_max(vol, date), 6) AS last FROM ck"))
def g41(spark, sf):
    d = grouped.book_volatility(windows(spark, sf))
    return d.agg(F.count(F.lit(1)).alias("dates"), rounding(F.avg("names"), 4).alias("mean_names"), *[rounding(x, 6).alias(n) for n, x in (("mean_volatility", F.avg("volatility")), ("least", F.min("volatility")), ("most", F.max("volatility")), ("last", F.max_by("volatility", "date")))])


@query("G46_caveats", sql(scored_sql(), ic_sql(), MARKET, "si AS (SELECT avg(ic) FILTER (WHERE tr > 0) AS up_ic, avg(ic) FILTER (WHERE tr <= 0) AS down_ic, avg(ic) AS gross, count(*) AS rebalances FROM ic LEFT JOIN st USING (date))", select="SELECT rebalances, concat_ws(',', 'survivorship', CASE WHEN rebalances = 0 THEN 'no_rebalances' END, CASE WHEN gross > 0 AND gross - 0.5 <= 0 THEN 'cost_not_survived' END, CASE WHEN up_ic * down_ic < 0 THEN 'state_dependent' END) AS codes FROM si"))
def g46(spark, sf):
    """One run: its IC as what it gains and half a unit as what it costs, without a membership table."""
    p = scored(spark, sf)
    d = metrics.rank_ic(p).join(metrics.trailing_state(metrics.market_return(p), 12).select("date", "state"), "date", "left")
    ic = lambda s: F.avg(F.when(F.col("state") == s, F.col("ic")))
    run = d.agg(F.avg("ic").alias("gross"), (F.avg("ic") - 0.5).alias("net"), F.count(F.lit(1)).alias("rebalances"), ic("up").alias("up_ic"), ic("down").alias("down_ic"), F.lit(False).alias("members"), F.lit(True).alias("fundamentals"))
    return studies.caveats(run).select("rebalances", "codes")


RECOMMENDED = """rc AS (SELECT so.date, so.symbol, coalesce(sector, 'UNKNOWN') AS sector, score, entry, stop, CAST(floor(CASE WHEN entry - stop > 0 AND entry > 0 THEN floor(least(1000000 * 0.01 / (entry - stop), 1000000 * 0.1 / entry)) ELSE 0 END * scale) AS BIGINT) AS wanted FROM so LEFT JOIN sc ON sc.symbol = so.symbol WHERE signal = 'BUY'),
 rq AS (SELECT *, least(wanted, CAST(floor(greatest(0.0, 250000 - coalesce(sum(wanted * entry) OVER (PARTITION BY date, sector ORDER BY score DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / entry) AS BIGINT)) AS quantity FROM rc)"""


@query("K14_recommendations", sql(TYPICAL, FEATURES_SQL, select_sql("mom", True), SECTORS, RECOMMENDED, select="SELECT date, symbol, sector, round(score, 2) AS score, quantity, round(quantity * entry, 2) AS investment, round(quantity * (entry - stop), 2) AS max_loss, CASE WHEN entry < 1100 THEN 'price' WHEN quantity <= 0 THEN 'quantity' WHEN quantity * entry > 60000 THEN 'position' ELSE 'passed' END AS compliance FROM rq"))
def k14(spark, sf):
    d = pit.sectors_of(selected(spark, sf, "mom", True), sectors(spark, sf))
    r = studies.recommendations(d, equity=1_000_000.0, least_price=1100.0, most=0.06)
    return r.select("date", "symbol", "sector", rounding("score", 2).alias("score"), "quantity", rounding("investment", 2).alias("investment"), rounding("max_loss", 2).alias("max_loss"), "compliance")


# ---- models --------------------------------------------------------------------------------------


@query("M9_ic_gradient", sql(scored_sql(), "mg AS (SELECT date, symbol, score - avg(score) OVER d AS p, forward_return - avg(forward_return) OVER d AS y, sqrt(var_pop(score) OVER d * count(*) OVER d) AS lp, sqrt(var_pop(forward_return) OVER d * count(*) OVER d) AS ly FROM p WINDOW d AS (PARTITION BY date)), mh AS (SELECT *, sum(CASE WHEN lp > 0 AND ly > 0 THEN p / lp * y / ly END) OVER (PARTITION BY date) AS c FROM mg)", select="SELECT date, symbol, round(c, 6) AS correlation, round(CASE WHEN lp > 0 AND ly > 0 THEN (y / ly - c * p / lp) / lp END, 6) AS gradient FROM mh"))
def m9(spark, sf):
    return out(studies.ic_gradient(scored(spark, sf)).select("date", "symbol", "correlation", "gradient"))


# ---- files ---------------------------------------------------------------------------------------


def through_csv(df: DataFrame, name: str) -> str:
    path = files.scratch(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


@query("A7_fundamentals_file", sql(FACTS, select="SELECT symbol, fiscal_date, report_date, round(revenue, 4) AS revenue, round(total_assets, 4) AS total_assets, CAST(NULL AS DOUBLE) AS total_debt FROM ff"))
def a7(spark, sf):
    d = facts(spark, sf)
    lacking = {c: F.lit(None).cast("double").alias(c) for c in ("operating_income", "total_debt", "cash_flow_operating", "shares_outstanding")}
    back = files.read_table(spark, through_csv(d.withColumns(lacking), "fundamentals"), files.FUNDAMENTALS)
    return back.select("symbol", "fiscal_date", "report_date", rounding("revenue", 4).alias("revenue"), rounding("total_assets", 4).alias("total_assets"), "total_debt")


@query("A8_free_float_file", sql(FLOATS, select="SELECT symbol, effective_date, round(free_float_shares, 4) AS free_float_shares, round(total_shares, 4) AS total_shares FROM fl"))
def a8(spark, sf):
    back = files.read_table(spark, through_csv(floats(spark, sf), "floats"), files.FREE_FLOAT)
    return back.select("symbol", "effective_date", rounding("free_float_shares", 4).alias("free_float_shares"), rounding("total_shares", 4).alias("total_shares"))


@query("A9_sector_file", sql(SECTORS, select="SELECT symbol, sector FROM sc"))
def a9(spark, sf):
    d = sectors(spark, sf).select(F.col("symbol").alias("Ticker"), F.col("sector").alias("GICS_Sector"))
    return files.read_sectors(spark, through_csv(d, "sectors"))


@query("A10_risk_free_file", "SELECT CAST(o_orderdate AS DATE) AS date, round(CAST(count(*) AS DOUBLE), 4) / 100 AS annualized_yield FROM orders GROUP BY 1")
def a10(spark, sf):
    """A curve in percent, brought to fractions as its largest value is over 1."""
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("annualized_yield"))
    back = files.read_table(spark, through_csv(d, "riskfree"), files.RISK_FREE)
    return files.as_fractions(back)


@query("A11_trial_log", "SELECT 'trial ' || CAST(s_suppkey AS VARCHAR) AS label, round(s_acctbal / 1000, 6) AS sharpe, CAST(s_nationkey AS VARCHAR) AS config_hash FROM supplier")
def a11(spark, sf):
    """Written in two appends, with lines that are no trial between them."""
    path = files.scratch(spark, "trials")
    s = table(spark, sf, "supplier")
    t = s.select(F.concat_ws(" ", F.lit("trial"), F.col("s_suppkey").cast("string")).alias("label"), (F.col("s_acctbal") / 1000).alias("sharpe"), F.col("s_nationkey").cast("string").alias("config_hash"))
    files.log_trial(t.where(s.s_suppkey % 2 == 0), path)
    s.limit(3).select(F.lit("{no trial").alias("value")).write.mode("append").text(path)
    files.log_trial(t.where(s.s_suppkey % 2 == 1), path)
    return files.read_trials(spark, path).select("label", rounding("sharpe", 6).alias("sharpe"), "config_hash")


@query("A12_outcomes", "SELECT CAST(o_orderkey AS VARCHAR) AS trade_id, CAST(o_orderdate AS DATE) AS entry_date, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS entry_price FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 ELSE true END")
def a12(spark, sf):
    """Open trades after a third of all were changed, half of these to closed."""
    o = table(spark, sf, "orders")
    row = lambda price, outcome: [F.col("o_orderkey").cast("string").alias("trade_id"), F.to_date("o_orderdate").alias("entry_date"), price.alias("entry_price"), outcome.alias("outcome")]
    known = o.select(*row(F.col("o_totalprice"), F.lit("PENDING")))
    changes = o.where("o_orderkey % 3 = 0").select(*row(F.col("o_totalprice") * 2, F.when(F.col("o_orderkey") % 2 == 0, "PENDING").otherwise("WIN")))
    d = files.trade_history(files.open_trades(files.upserted(known, changes, key="trade_id")))
    return d.select("trade_id", "entry_date", rounding("entry_price", 2).alias("entry_price"))


@query("A13_written_bars", sql(bars_sql("month"), select="SELECT symbol, date, round(close, 6) AS close FROM b WHERE CAST(symbol AS INTEGER) % 7 <> 0"))
def a13(spark, sf):
    """Every seventh symbol has no number at all and is not written."""
    b, path = bars(spark, sf, "month"), files.scratch(spark, "bars")
    none = F.col("symbol").cast("int") % 7 == 0
    write_bars(b.select("symbol", "date", *[F.when(~none, F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")]), path)
    return spark.read.parquet(path).select("symbol", "date", rounding("close", 6).alias("close"))


@query("W23_lagged_inputs", sql(bars_sql("month"), "gr AS (SELECT s.symbol, d.date, b.close, b.volume FROM (SELECT DISTINCT symbol FROM b) s CROSS JOIN (SELECT DISTINCT date FROM b) d LEFT JOIN b ON b.symbol = s.symbol AND b.date = d.date), lg AS (SELECT symbol, date, lag(close) OVER w AS c, lag(volume) OVER w AS v FROM gr WINDOW w AS (PARTITION BY symbol ORDER BY date))", select="SELECT symbol, date, round(c / avg(c) OVER (PARTITION BY date), 6) AS relative_price, round(ln(c * v), 6) AS log_value FROM lg"))
def w23(spark, sf):
    """Features of a date's cross-section, whose inputs are all as they stood a row before."""
    made = {"relative_price": lambda c: c["close"] / F.avg(c["close"]).over(across("date")), "log_value": lambda c: F.log(c["close"] * c["volume"])}
    return out(features.cross_sectional(bars(spark, sf, "month"), ["close", "volume"], made))


def arriving(df: DataFrame, batch: str, start, name: str) -> None:
    """``df`` as a stream that arrives in batches by the number in ``batch``: each is written and taken up by a run of its own, from the last one's checkpoint.

    A batch waits in a folder of its own, which goes as it arrives: no row lies on disk twice but those arriving.
    """
    spark, path = df.sparkSession, files.scratch(df.sparkSession, name)
    checkpoint, waiting = files.scratch(spark, f"{name}-checkpoint"), files.scratch(spark, f"{name}-waiting")
    df.write.partitionBy(batch).parquet(waiting)
    plain = df.drop(batch).schema
    for number in sorted(r[0] for r in spark.read.schema(df.schema).parquet(waiting).select(batch).distinct().collect()):
        rows = spark.read.schema(plain).parquet(f"{waiting}/{batch}={number}")
        rows.write.mode("append").parquet(path)
        files.discarded(rows)
        start(spark.readStream.schema(plain).parquet(path), checkpoint).awaitTermination()


BODY = "1e-9 * greatest(abs(greatest(open, close)), 1.0)"
#: Every third symbol has the planted faults, every other third some bars twice.
ARRIVALS = f"""d3 AS (SELECT symbol, date, open, high, low, close, volume FROM d WHERE CAST(symbol AS INTEGER) % 3 = 0 UNION ALL SELECT symbol, date, open, high, low, close, volume FROM b WHERE CAST(symbol AS INTEGER) % 3 <> 0 UNION ALL SELECT symbol, date, open, high, low, close, volume FROM b WHERE CAST(symbol AS INTEGER) % 3 = 1 AND date_diff('day', DATE '1992-01-01', date) % 400 = 9),
 dq AS (SELECT *, CAST(symbol AS INTEGER) * 1000000 + date_diff('day', DATE '1992-01-01', date) AS k FROM d3), da AS (SELECT *, (k + row_number() OVER (PARTITION BY symbol, date)) % 3 AS batch FROM dq),
 vb AS (SELECT symbol, batch FROM da WHERE high < greatest(open, close) - {BODY} OR low > least(open, close) + {BODY} OR high < low - {BODY} OR coalesce(open, 0) <= 0 OR coalesce(high, 0) <= 0 OR coalesce(low, 0) <= 0 OR coalesce(close, 0) <= 0 OR volume < 0
  UNION SELECT symbol, max(batch) FROM da GROUP BY symbol, date HAVING count(*) > 1)"""


@query("S2_ingest_gate", sql(bars_sql("day"), DIRTY, ARRIVALS, select="SELECT symbol, CAST(batch AS INTEGER) AS batch, count(*) AS rows, vb.symbol IS NULL AS accepted FROM da LEFT JOIN vb USING (symbol, batch) GROUP BY ALL"))
def s2(spark, sf):
    """Daily bars with planted faults arrive in three batches, the second of two equal rows in another one than the first; both tables they are parted into are read back."""
    good, bad = files.scratch(spark, "accepted"), files.scratch(spark, "quarantine")
    k = F.col("symbol").cast("long") * 1_000_000 + F.date_diff("date", F.lit("1992-01-01").cast("date"))
    legs = ["symbol", "date", "open", "high", "low", "close", "volume"]
    third, b = F.col("symbol").cast("int") % 3, bars(spark, sf, "day").select(legs)
    d = dirty(spark, sf).where(third == 0).select(legs).unionByName(b.where(third != 0)).unionByName(b.where((third == 1) & (F.date_diff("date", F.lit("1992-01-01").cast("date")) % 400 == 9)))
    d = d.withColumn("arrival", ((k + F.row_number().over(Window.partitionBy("symbol", "date").orderBy("close"))) % 3).cast("int"))
    arriving(d, "arrival", lambda stream, at: streaming.gate(stream, good, bad, at, days=10_000), "arrivals")
    count = lambda path, ok: spark.read.schema(f"{BAR}, batch int").parquet(path).groupBy("symbol", "batch").agg(F.count(F.lit(1)).alias("rows")).withColumn("accepted", F.lit(ok))
    return count(good, True).unionByName(count(bad, False))


@query("S3_breaker_events", "WITH RECURSIVE " + ",".join([bars_sql("month"), CURVES, "n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY date) AS i FROM cu)", W29]) + " SELECT book_id, date, event FROM br WHERE event <> ''")
def s3(spark, sf):
    """The curves of all books arrive in batches of two years, a quarter of the rows one batch late; state is kept for each book, and a last row without a book moves the watermark past all others."""
    path = files.scratch(spark, "events")
    batch = F.floor(F.year("date") / 2) + F.when(F.pmod(F.xxhash64("book_id", "date"), F.lit(4)) == 0, 1).otherwise(0)
    d = curves(spark, sf).select("book_id", "date", "value", batch.cast("int").alias("arrival"))
    end = d.agg(F.date_add(F.max("date"), 10_000).alias("date"), (F.max("arrival") + 1).alias("arrival")).select(F.lit("").alias("book_id"), "date", F.lit(1.0).alias("value"), "arrival")

    def start(stream: DataFrame, checkpoint: str):
        events = streaming.breaker(stream, halt=0.15, resume=0.05, cooldown=10, late="1500 days")
        return events.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    arriving(d.unionByName(end), "arrival", start, "curves")
    return spark.read.schema(streaming.BREAKER).parquet(path).select("book_id", "date", "event")
