"""Queries that measure a score (G, P1, P2, J9, E6, K12, K13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding
from crossgrain.functions import expressions as X
from crossgrain.operators import books, metrics, pit
from crossgrain.plans.common import BUCKETS, average_rank_sql, bucketed_sql, ic_sql, out, scored, scored_sql, sql
from crossgrain.plans.registry import query
from crossgrain.sources import files

LAGS = 2
RT = X.round_trip()


def nw_sql(source: str = "ic", keys: str = "", value: str = "ic", lags: int = LAGS, order: str = "date") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    products = ", ".join(f"d * lag(d, {i}) OVER ({part} ORDER BY {order}) AS p{i}" for i in range(1, lags + 1))
    terms = " + ".join(f"CASE WHEN count(d) > {i} THEN 2 * (1 - {i} / (least({lags}, count(d) - 1) + 1.0)) * coalesce(sum(p{i}), 0) / count(d) ELSE 0 END" for i in range(1, lags + 1)) or "0"
    products = f", {products}" if lags else ""
    return f"""nw AS (SELECT {k}count(v) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, sqrt(greatest(sum(d * d) / count(d) + {terms}, 0) / count(d)) AS se, avg(CASE WHEN v > 1e-12 THEN 1.0 ELSE 0.0 END) AS positive
        FROM (SELECT *{products} FROM (SELECT {k}{order}, {value} AS v, {value} - avg({value}) OVER ({part}) AS d FROM {source})) {'GROUP BY ' + keys if keys else ''})"""


SUMMARY = "n AS dates, round(mean, 6) AS mean_ic, round(sd, 6) AS sd_ic, round(CASE WHEN sd <> 0 THEN mean / sd ELSE 0 END, 6) AS icir, round(CASE WHEN se <> 0 THEN mean / se ELSE 0 END, 6) AS t, round(positive, 6) AS positive_share"


@query("P1_validated", sql(scored_sql(), select="SELECT date, symbol, round(score,6) score, round(forward_return,6) forward_return FROM p"))
def validated(spark, sf):
    return out(scored(spark, sf).select("date", "symbol", "score", "forward_return"))


@query("P2_absurd_labels", sql(scored_sql(), select="SELECT count(*) AS rows, round(max(abs(forward_return)), 6) AS largest FROM p"))
def absurd(spark, sf):
    return out(scored(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs("forward_return")).alias("largest")))


@query("G1_rank_ic", sql(scored_sql(), ic_sql(), select="SELECT date, round(ic, 6) AS ic, names FROM ic"))
def rank_ic(spark, sf):
    return out(metrics.rank_ic(scored(spark, sf)))


@query("G2_ic_summary", sql(scored_sql(), ic_sql(), nw_sql(), select=f"SELECT {SUMMARY} FROM nw"))
def ic_summary(spark, sf):
    return out(metrics.ic_summary(metrics.rank_ic(scored(spark, sf)), LAGS))


@query("G3_newey_west", sql(scored_sql(), ic_sql(), nw_sql(lags=4), select="SELECT n, round(mean,6) mean, round(sd,6) sd, round(se,8) se FROM nw"))
def newey_west(spark, sf):
    d = metrics.newey_west(metrics.rank_ic(scored(spark, sf)), 4)
    return d.select("n", rounding("mean", 6).alias("mean"), rounding("sd", 6).alias("sd"), rounding("se", 8).alias("se"))


DAILY = "dl AS (SELECT date, bucket, avg(forward_return) AS r FROM q GROUP BY ALL), br AS (SELECT bucket, avg(r) AS mean_return, count(*) AS dates FROM dl GROUP BY bucket)"
SPREAD = f"""bs AS (SELECT arg_max(mean_return, bucket) - arg_min(mean_return, bucket) AS spread, corr(bucket, rk) AS monotonicity, avg(step) AS rising_share FROM (SELECT *, rank() OVER (ORDER BY mean_return) AS rk, CAST(mean_return > lag(mean_return) OVER (ORDER BY bucket) AS DOUBLE) AS step FROM br))"""


@query("G4_bucket_returns", sql(scored_sql(), bucketed_sql(), DAILY, select="SELECT bucket, round(mean_return, 6) AS mean_return, dates FROM br"))
def bucket_returns(spark, sf):
    return out(metrics.bucket_returns(scored(spark, sf), BUCKETS, "date"))


@query("G4_bucket_summary", sql(scored_sql(), bucketed_sql(), DAILY, SPREAD, select="SELECT round(spread,6) spread, round(monotonicity,6) monotonicity, round(rising_share,6) rising_share FROM bs"))
def bucket_summary(spark, sf):
    return out(metrics.bucket_summary(scored(spark, sf), BUCKETS, "date"))


HIT = """h AS (SELECT avg(CASE WHEN s = r THEN 1.0 ELSE 0.0 END) AS hit_rate, count(*) AS graded FROM (SELECT sign(score - median(score) OVER d) AS s, sign(forward_return - avg(forward_return) OVER d) AS r, min(score) OVER d = max(score) OVER d AS flat FROM p WINDOW d AS (PARTITION BY date)) WHERE NOT flat AND s <> 0)"""


@query("G5_hit_rate", sql(scored_sql(), HIT, select="SELECT round(hit_rate, 6) AS hit_rate, graded FROM h"))
def hit_rate(spark, sf):
    return out(metrics.hit_rate(scored(spark, sf), "date"))


QUANTILES = ", ".join(f"round(quantile_cont(e, {q / 100}), 6) AS p{q}" for q in (5, 25, 50, 75, 95))


@query("G6_rank_errors", sql(scored_sql(), bucketed_sql(), f"e AS (SELECT bucket, {average_rank_sql('score')} / (count(*) OVER (PARTITION BY date) + 1) - {average_rank_sql('forward_return')} / (count(*) OVER (PARTITION BY date) + 1) AS e FROM q)", select=f"SELECT bucket, round(avg(abs(e)),6) AS mean_abs_error, count(*) AS rows, {QUANTILES} FROM e GROUP BY bucket UNION ALL SELECT NULL, round(avg(abs(e)),6), count(*), {QUANTILES} FROM e"))
def rank_errors(spark, sf):
    return out(metrics.rank_errors(scored(spark, sf), BUCKETS))


@query("G7_score_dispersion", sql(scored_sql(), select="SELECT round(avg(d), 6) AS dispersion FROM (SELECT count(DISTINCT score) / count(score) AS d FROM p GROUP BY date)"))
def dispersion(spark, sf):
    return out(metrics.score_dispersion(scored(spark, sf)))


HORIZONS = (1, 2, 4, 8)
DECAY = "hs AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, date, score, forward_return_{h} AS forward_return FROM p WHERE forward_return_{h} IS NOT NULL" for h in HORIZONS) + ")"


def decay_sql() -> str:
    parts = [scored_sql(horizons=HORIZONS), DECAY, ic_sql("horizon, date", "hs")]
    unions = []
    for h in HORIZONS:
        one = nw_sql(f"(SELECT * FROM ic WHERE horizon = {h})", "horizon", lags=metrics.overlap_lags(h, 1)).replace("nw AS", f"nw{h} AS", 1)
        parts.append(one)
        unions.append(f"SELECT CAST(horizon AS BIGINT) AS horizon, mean AS mean_ic, n AS dates, CASE WHEN se <> 0 THEN mean / se ELSE 0 END AS t FROM nw{h}")
    return sql(*parts, "dc AS (" + " UNION ALL ".join(unions) + ")", select="")


@query("G8_decay", decay_sql() + "SELECT horizon, round(mean_ic,6) mean_ic, dates, round(t,6) t FROM dc")
def decay(spark, sf):
    return out(metrics.decay(files.written(scored(spark, sf, horizons=HORIZONS), "panel"), HORIZONS))


HALF = "pk AS (SELECT horizon AS peak_horizon, mean_ic AS peak_ic FROM dc ORDER BY abs(mean_ic) DESC, horizon LIMIT 1), hv AS (SELECT horizon, mean_ic * sign(peak_ic) AS v, abs(peak_ic) / 2 AS half, peak_horizon FROM dc, pk WHERE horizon >= peak_horizon), hc AS (SELECT h0 + (v0 - half) / (v0 - v) * (horizon - h0) AS half_life FROM (SELECT *, lag(v) OVER (ORDER BY horizon) AS v0, lag(horizon) OVER (ORDER BY horizon) AS h0 FROM hv) WHERE v0 > half AND v <= half ORDER BY horizon LIMIT 1)"


@query("G8_half_life", decay_sql().rstrip() + ", " + HALF + " SELECT peak_horizon, round(peak_ic, 6) AS peak_ic, round(half_life, 6) AS half_life FROM pk LEFT JOIN hc ON true")
def half_life(spark, sf):
    panel = files.written(scored(spark, sf, horizons=HORIZONS), "panel")
    return out(metrics.half_life(files.written(metrics.decay(panel, HORIZONS), "decay")))


FOLDS = """dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM p)),
 fd AS (SELECT f AS fold, date, CASE WHEN i >= floor(n * f / 5) AND i < floor(n * (f + 1) / 5) THEN 'test' WHEN i < floor(n * f / 5) - 1 - 2 THEN 'train' END AS role FROM dd CROSS JOIN (SELECT CAST(unnest(range(1, 5)) AS BIGINT) AS f))"""


@query("W17_folds", sql(scored_sql(), FOLDS, select="SELECT fold, date, role FROM fd WHERE role IS NOT NULL"))
def folds(spark, sf):
    return metrics.folds(scored(spark, sf), folds=4, horizon=1, embargo=2)


@query("G9_fold_evaluation", sql(scored_sql(), ic_sql(), FOLDS, "fi AS (SELECT fold, ic.date, ic FROM ic JOIN fd ON ic.date = fd.date AND role = 'test')", nw_sql("fi", "fold"), select=f"SELECT fold, {SUMMARY} FROM nw"))
def fold_evaluation(spark, sf):
    p = scored(spark, sf)
    test = metrics.folds(p, folds=4, horizon=1, embargo=2).where("role = 'test'").select("fold", "date")
    return out(metrics.ic_summary(metrics.rank_ic(p).join(F.broadcast(test), "date"), LAGS, "fold"))


MARKET = "mk AS (SELECT date, avg(forward_return) AS market FROM p GROUP BY date), st AS (SELECT date, CASE WHEN count(market) OVER w = 12 THEN sum(market) OVER w END AS tr FROM mk WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"


@query("G11_market_return", sql(scored_sql(), MARKET, select="SELECT date, round(market,6) market FROM mk"))
def market(spark, sf):
    return out(metrics.market_return(scored(spark, sf)))


@query("W21_trailing_state", sql(scored_sql(), MARKET, select="SELECT date, round(tr,6) AS \"trailing\", CASE WHEN tr > 0 THEN 'up' WHEN tr <= 0 THEN 'down' END AS state FROM st"))
def states(spark, sf):
    return out(metrics.trailing_state(metrics.market_return(scored(spark, sf)), 12))


@query("G10_conditional_ic", sql(scored_sql(), ic_sql(), MARKET, "ci AS (SELECT coalesce(CASE WHEN tr > 0 THEN 'up' WHEN tr <= 0 THEN 'down' END, 'none') AS state, ic.date, ic FROM ic LEFT JOIN st USING (date))", nw_sql("ci", "state"), select=f"SELECT state, {SUMMARY} FROM nw"))
def conditional(spark, sf):
    p = scored(spark, sf)
    return out(metrics.conditional_ic(p, metrics.trailing_state(metrics.market_return(p), 12), lags=LAGS))


TOP = f"tp AS (SELECT date, symbol FROM q WHERE bucket = {BUCKETS - 1}), dr AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM tp)), th AS (SELECT tp.*, r FROM tp JOIN dr USING (date)), tn AS (SELECT a.date, avg(CASE WHEN b.symbol IS NULL THEN 1.0 ELSE 0.0 END) AS turnover, count(*) AS names FROM th a LEFT JOIN th b ON a.symbol = b.symbol AND a.r = b.r + 1 WHERE a.r > 1 GROUP BY a.date)"


@query("K13_bucket_members", sql(scored_sql(), bucketed_sql(), TOP, select="SELECT date, symbol FROM tp"))
def members(spark, sf):
    return metrics.bucket_members(scored(spark, sf), BUCKETS)


@query("J9_turnover", sql(scored_sql(), bucketed_sql(), TOP, select="SELECT date, round(turnover,6) turnover, names FROM tn"))
def turnover(spark, sf):
    return out(metrics.turnover(metrics.bucket_members(scored(spark, sf), BUCKETS)))


@query("G13_turnover_summary", sql(scored_sql(), bucketed_sql(), TOP, select="SELECT round(avg(turnover),6) turnover, count(*) AS rebalances FROM tn"))
def turnover_summary(spark, sf):
    t = metrics.turnover(metrics.bucket_members(scored(spark, sf), BUCKETS))
    return out(t.agg(F.avg("turnover").alias("turnover"), F.count(F.lit(1)).alias("rebalances")))


@query("G12_net_spread", sql(scored_sql(), bucketed_sql(), DAILY, SPREAD, TOP, f"x AS (SELECT spread, (SELECT avg(r) FROM dl WHERE bucket = {BUCKETS - 1}) AS lg, (SELECT avg(turnover) FROM tn) AS t, (SELECT count(*) FROM tn) AS n FROM bs)", select=f"SELECT round(spread,6) gross, round(t,6) turnover, n AS rebalances, round(spread - 2*t*{RT!r},6) net, round(lg - t*{RT!r},6) long_only_net, round(spread/(2*t),6) break_even, round((spread-2*t*{RT!r})*52.0,6) net_per_year, round(2*t*{RT!r}/abs(spread),6) cost_share FROM x"))
def net_spread(spark, sf):
    return out(metrics.net_spread(scored(spark, sf), BUCKETS, round_trip=RT, stride=1, per_year=52))


def two_strategies(spark, sf):
    p = scored(spark, sf)
    reverse = p.withColumn("score", -F.col("score"))
    return p.withColumn("strategy", F.lit("momentum")).unionByName(reverse.withColumn("strategy", F.lit("reversal")))


TWO = "p2 AS (SELECT *, 'momentum' AS strategy FROM p UNION ALL SELECT date, symbol, close, volume, -score, forward_return, 'reversal' FROM p)"


@query(
    "G14_evaluation_rollup",
    sql(
        scored_sql(), TWO, ic_sql("strategy, date", "p2"), nw_sql("ic", "strategy"), bucketed_sql("strategy, date", "p2"),
        "dl AS (SELECT strategy, date, bucket, avg(forward_return) AS r FROM q GROUP BY ALL), br AS (SELECT strategy, bucket, avg(r) AS mean_return FROM dl GROUP BY ALL)",
        "bs AS (SELECT strategy, arg_max(mean_return, bucket) - arg_min(mean_return, bucket) AS spread, corr(bucket, rk) AS monotonicity, avg(step) AS rising_share FROM (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY mean_return) AS rk, CAST(mean_return > lag(mean_return) OVER (PARTITION BY strategy ORDER BY bucket) AS DOUBLE) AS step FROM br) GROUP BY strategy)",
        HIT.replace("SELECT avg(CASE", "SELECT strategy, avg(CASE").replace("(SELECT sign(score", "(SELECT strategy, sign(score").replace("FROM p WINDOW d AS (PARTITION BY date)", "FROM p2 WINDOW d AS (PARTITION BY strategy, date)").replace("s <> 0)", "s <> 0 GROUP BY strategy)"),
        "ct AS (SELECT strategy, count(*) AS rows, count(DISTINCT date) AS all_dates, count(DISTINCT symbol) AS symbols FROM p2 GROUP BY strategy), ds AS (SELECT strategy, avg(d) AS dispersion FROM (SELECT strategy, date, count(DISTINCT score) / count(score) AS d FROM p2 GROUP BY ALL) GROUP BY strategy)",
        select=f"SELECT strategy, rows, all_dates, symbols, {SUMMARY}, round(spread,6) spread, round(monotonicity,6) monotonicity, round(rising_share,6) rising_share, round(hit_rate,6) hit_rate, graded, round(dispersion,6) dispersion FROM ct JOIN nw USING (strategy) JOIN bs USING (strategy) JOIN h USING (strategy) JOIN ds USING (strategy)",
    ),
)
def rollup(spark, sf):
    return out(metrics.evaluated(files.written(two_strategies(spark, sf), "panel"), buckets=BUCKETS, lags=LAGS))


SECTOR = "sx AS (SELECT p.*, coalesce(n_name, 'UNKNOWN') AS sector, ln(volume) AS size FROM p LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0) ON CAST(s_suppkey AS VARCHAR) = symbol)"
RESIDUAL = """rs AS (SELECT *, y - avg(y) OVER d - coalesce(covar_pop(x, y) OVER d / nullif(var_pop(x) OVER d, 0), 0) * (x - avg(x) OVER d) AS residual FROM (SELECT *, score - avg(score) OVER g AS y, size - avg(size) OVER g AS x FROM sx WINDOW g AS (PARTITION BY date, sector)) WINDOW d AS (PARTITION BY date))"""


def exposed(spark, sf):
    from crossgrain.plans.pit import sectors

    return pit.sectors_of(scored(spark, sf), sectors(spark, sf)).withColumn("size", F.log("volume"))


@query("M1_neutralized", sql(scored_sql(), SECTOR, RESIDUAL, select="SELECT date, symbol, sector, round(residual,6) residual FROM rs"))
def neutralized(spark, sf):
    return out(pit.residual(exposed(spark, sf), "size", group="sector").select("date", "symbol", "sector", "residual"))


@query("G15_neutralized_ic", sql(scored_sql(), SECTOR, RESIDUAL, ic_sql(), ic_sql(source="(SELECT date, round(residual, 9) AS residual, forward_return FROM rs)", score="residual").replace("ic AS", "ir AS", 1), select="SELECT round(avg(ic.ic),5) raw_ic, round(avg(ir.ic),5) residual_ic, count(*) AS dates FROM ic JOIN ir USING (date)"))
def neutralized_ic(spark, sf):
    d = pit.residual(exposed(spark, sf), "size", group="sector").withColumn("residual", rounding("residual", 9))
    a, b = metrics.rank_ic(d), metrics.rank_ic(d, score="residual").select("date", F.col("ic").alias("ir"))
    return a.join(b, "date").agg(rounding(F.avg("ic"), 5).alias("raw_ic"), rounding(F.avg("ir"), 5).alias("residual_ic"), F.count(F.lit(1)).alias("dates"))


@query("W35_evaluation_dates", sql(scored_sql(), select="SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM p)) WHERE (n - 1) % 4 = 0"))
def evaluation_dates(spark, sf):
    return metrics.evaluation_dates(scored(spark, sf), stride=4)


@query("K12_worst_dates", sql(scored_sql(), ic_sql(), select="SELECT date, round(ic,6) ic, names FROM ic ORDER BY ic, date LIMIT 10"))
def worst_dates(spark, sf):
    return out(metrics.rank_ic(scored(spark, sf)).orderBy("ic", "date").limit(10))


EQUAL = f"eq AS (SELECT date, symbol, 1.0 / count(*) OVER (PARTITION BY date) AS weight, forward_return FROM q WHERE bucket = {BUCKETS - 1})"


@query("E6_equal_weight_book", sql(scored_sql(), bucketed_sql(), EQUAL, select="SELECT date, symbol, round(weight,6) weight FROM eq"))
def equal_book(spark, sf):
    return out(books.equal_weights(scored(spark, sf), BUCKETS).select("date", "symbol", "weight"))


WT = """wr AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM eq)), wn AS (SELECT symbol, r, weight FROM eq JOIN wr USING (date)),
 wt AS (SELECT date, t AS turnover FROM (SELECT r, sum(abs(coalesce(w1, 0) - coalesce(w0, 0))) / 2 AS t FROM (SELECT coalesce(a.r, b.r + 1) AS r, a.weight AS w1, b.weight AS w0 FROM wn a FULL JOIN wn b ON a.symbol = b.symbol AND a.r = b.r + 1) GROUP BY r) JOIN wr USING (r)),
 bk AS (SELECT date, sum(weight * forward_return) AS gross, count(*) FILTER (WHERE weight > 0) AS names, max(weight) AS max_weight FROM eq GROUP BY date),
 bn AS (SELECT bk.*, turnover, gross - turnover * """ + repr(RT) + """ AS net FROM bk JOIN wt USING (date))"""


@query("W30_weight_turnover", sql(scored_sql(), bucketed_sql(), EQUAL, WT, select="SELECT date, round(turnover,6) turnover FROM wt"))
def weight_turnover(spark, sf):
    return out(books.weight_turnover(books.equal_weights(scored(spark, sf), BUCKETS)))


@query("W31_compounded", sql(scored_sql(), bucketed_sql(), EQUAL, WT, select="SELECT date, round(sum(ln(1 + net)) OVER (ORDER BY date), 6) AS log_equity FROM bn"))
def compounded(spark, sf):
    d = books.compounded(books.book_returns(books.equal_weights(scored(spark, sf), BUCKETS), RT))
    return d.select("date", rounding(F.log("equity"), 6).alias("log_equity"))


@query("G16_book_metrics", sql(scored_sql(), bucketed_sql(), EQUAL, WT, select="SELECT round(avg(gross),6) mean_gross, round(avg(net),6) mean_net, round(avg(turnover),6) mean_turnover, round(avg(gross)-avg(net),6) drag, round(avg(net)*52,6) annual_return, round(stddev_samp(net)*sqrt(52.0),6) annual_volatility, round(avg(net)*sqrt(52.0)/stddev_samp(net),6) sharpe, round(avg(names),6) names, round(max(max_weight),6) max_weight, count(*) AS periods FROM bn"))
def book_metrics(spark, sf):
    return out(books.book_summary(books.book_returns(books.equal_weights(scored(spark, sf), BUCKETS), RT), 52))


@query("G43_annualized_icir", sql(scored_sql(), ic_sql().replace("count(*) >= 5", "count(*) >= 2"), select="SELECT count(*) AS dates, round(avg(ic),6) mean_ic, round(avg(ic)/stddev_samp(ic)*sqrt(252/5.0),6) icir FROM ic"))
def annual_icir(spark, sf):
    d = metrics.rank_ic(scored(spark, sf), min_names=2)
    return out(d.agg(F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean_ic"), (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * (252 / 5) ** 0.5).alias("icir")))


@query("K9_rank_composite", sql(scored_sql(), select=f"SELECT date, symbol, round({average_rank_sql('score')} / count(*) OVER (PARTITION BY date), 6) AS r_score, round({average_rank_sql('volume')} / count(*) OVER (PARTITION BY date), 6) AS r_volume FROM p"))
def rank_composite(spark, sf):
    from crossgrain.operators.signals import rank_components

    return out(rank_components(scored(spark, sf), ["score", "volume"]).select("date", "symbol", "r_score", "r_volume"))


