"""Queries over the checks of bars (V, J11, W20, W33, G35, G36, P3-P5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.operators import quality as q
from crossgrain.plans.common import out, sql
from crossgrain.plans.features import ADJUSTED, adjusted
from crossgrain.plans.registry import query
from crossgrain.sources import files
from crossgrain.sources.bars import bars, bars_sql, table

SEQ = "CAST(symbol AS INTEGER) * 1000000 + date_diff('day', DATE '1992-01-01', date) AS seq"
DIRTY = f"""k AS (SELECT *, {SEQ} FROM b), dd AS (SELECT symbol, date, open, CASE WHEN seq % 97 = 3 THEN low * 0.5 ELSE high END AS high, CASE WHEN seq % 89 = 4 THEN high * 2 ELSE low END AS low, CASE WHEN seq % 101 = 5 THEN -close WHEN seq % 103 = 6 THEN NULL ELSE close END AS close, CASE WHEN seq % 107 = 7 THEN -volume ELSE volume END AS volume, CASE WHEN seq % 113 = 8 THEN seq - 30 ELSE seq END AS seq FROM k),
 d AS (SELECT * FROM dd UNION ALL SELECT * FROM dd WHERE seq % 109 = 9)"""


def dirty(spark, sf) -> DataFrame:
    """Daily bars with planted faults, and an ingest sequence."""
    seq = F.col("symbol").cast("long") * 1_000_000 + F.date_diff("date", F.lit("1992-01-01").cast("date"))
    b = bars(spark, sf, "day").withColumn("seq", seq)
    at = lambda m, r: F.col("seq") % m == r
    b = b.select(
        "symbol", "date", "open", F.when(at(97, 3), F.col("low") * 0.5).otherwise(F.col("high")).alias("high"), F.when(at(89, 4), F.col("high") * 2).otherwise(F.col("low")).alias("low"),
        F.when(at(101, 5), -F.col("close")).when(~at(103, 6), F.col("close")).alias("close"), F.when(at(107, 7), -F.col("volume")).otherwise(F.col("volume")).alias("volume"), F.when(at(113, 8), F.col("seq") - 30).otherwise(F.col("seq")).alias("seq"),
    )
    twice = F.when(at(109, 9), 2).otherwise(1)  # by copies of the row, so that the trades are read once
    return b.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), twice))).drop("_copy")


def violation_sql(source: str, where: str, check: str, severity: str, detail: str, count: str = "count(*)") -> str:
    return f"SELECT '{check}' AS \"check\", '{severity}' AS severity, symbol, CAST({count} AS BIGINT) AS count, '{detail}' AS detail, array_to_string(list_sort(list(CAST(date AS VARCHAR)) FILTER (WHERE n <= 3)), ',') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM {source} WHERE {where}) GROUP BY symbol"


def flat(d: DataFrame) -> DataFrame:
    """Examples as one string, as the oracle has them."""
    return d.withColumn("examples", F.array_join("examples", ","))


B1 = "1e-9 * greatest(abs(greatest(open, close)), 1.0)"
V1 = " UNION ALL ".join([violation_sql("d", f"high < greatest(open, close) - {B1}", "high_below_body", "structural", "order of prices"), violation_sql("d", f"low > least(open, close) + {B1}", "low_above_body", "structural", "order of prices"), violation_sql("d", f"high < low - {B1}", "high_below_low", "structural", "order of prices")])


@query("V1_price_order", sql(bars_sql("day"), DIRTY, select=V1))
def v1(spark, sf):
    return flat(q.price_order(dirty(spark, sf)))


V2 = " UNION ALL ".join([violation_sql("d", f"coalesce({c}, 0) <= 0", f"non_positive_{c}", "structural", c) for c in ("open", "high", "low", "close")] + [violation_sql("d", "volume < 0", "negative_volume", "structural", "volume")])


@query("V2_positive_prices", sql(bars_sql("day"), DIRTY, select=V2))
def v2(spark, sf):
    return flat(q.positive_prices(dirty(spark, sf)))


V3 = violation_sql("(SELECT symbol, date, count(*) - 1 AS extra FROM d GROUP BY ALL HAVING count(*) > 1)", "true", "duplicate_date", "structural", "date", "sum(extra)")


@query("V3_duplicate_dates", sql(bars_sql("day"), DIRTY, select=V3))
def v3(spark, sf):
    return flat(q.duplicate_dates(dirty(spark, sf)))


@query("V4_unsorted_input", sql(bars_sql("day"), DIRTY.replace("d AS (SELECT * FROM dd UNION ALL SELECT * FROM dd WHERE seq % 109 = 9)", "d AS (SELECT * FROM dd)"), select=violation_sql("(SELECT *, lag(date) OVER (PARTITION BY symbol ORDER BY seq, date) AS prev FROM d)", "prev > date", "unsorted", "structural", "order of dates")))
def v4(spark, sf):
    d = dirty(spark, sf).dropDuplicates(["symbol", "date"]).withColumn("seq", F.struct("seq", "date"))
    return flat(q.unsorted(d, "seq"))


MOVES = "mv AS (SELECT symbol, date, abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) AS m FROM b)"


@query("V5_extreme_returns", sql(bars_sql(), MOVES, select=violation_sql("mv", "m >= 0.25 AND m < 0.6", "extreme_return", "advisory", "return") + " UNION ALL " + violation_sql("mv", "m >= 0.6", "split_scale_return", "advisory", "return")))
def v5(spark, sf):
    return flat(q.extreme_returns(bars(spark, sf)))


@query("V6_unexplained_factor", sql(bars_sql(), ADJUSTED, select=violation_sql("(SELECT *, abs(adj_factor / lag(adj_factor) OVER w - 1) AS f FROM g WINDOW w AS (PARTITION BY symbol ORDER BY date))", "f > 0.005 AND stock_splits = 0 AND dividends = 0", "unexplained_factor", "advisory", "adj_factor")))
def v6(spark, sf):
    return flat(q.unexplained_factor(adjusted(spark, sf)))


V7 = violation_sql("(SELECT symbol, count(*) AS c, min(date) AS date FROM b GROUP BY symbol)", "c < 300", "short_history", "advisory", "sessions", "max(c)")


@query("V7_short_history", sql(bars_sql(), select=V7))
def v7(spark, sf):
    return flat(q.short_history(bars(spark, sf), 300))


CAL = """sp AS (SELECT symbol, min(date) AS f, max(date) AS l FROM b GROUP BY symbol), tr AS (SELECT date, count(DISTINCT symbol) AS traded FROM b GROUP BY date),
 cl AS (SELECT tr.date FROM tr JOIN sp ON tr.date BETWEEN f AND l GROUP BY tr.date, traded HAVING count(*) >= 2 AND traded >= 0.6 * count(*)),
 ms AS (SELECT sp.symbol, c.date, c.position FROM (SELECT date, row_number() OVER (ORDER BY date) AS position FROM cl) c JOIN sp ON c.date BETWEEN f AND l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = sp.symbol AND b.date = c.date))"""


@query("V9_trading_calendar", sql(bars_sql(), CAL, select="SELECT date FROM cl"))
def v9(spark, sf):
    return q.trading_calendar(bars(spark, sf))


@query("J11_missing_sessions", sql(bars_sql(), CAL, select="SELECT symbol, date, position FROM ms"))
def j11(spark, sf):
    b = bars(spark, sf)
    d = q.missing_sessions(b, q.trading_calendar(b))
    return d.withColumn("position", F.col("position").cast("long"))


GAPS = "gp AS (SELECT symbol, sum(run) AS missing, max(run) AS longest FROM (SELECT symbol, count(*) AS run FROM (SELECT symbol, position - row_number() OVER (PARTITION BY symbol ORDER BY position) AS island FROM ms) GROUP BY symbol, island) GROUP BY symbol)"


@query("W20_longest_gap", sql(bars_sql(), CAL, GAPS, select="SELECT symbol, CAST(missing AS BIGINT) missing, CAST(longest AS BIGINT) longest FROM gp"))
def w20(spark, sf):
    b = bars(spark, sf)
    return q.longest_gap(q.missing_sessions(b, q.trading_calendar(b)))


V8 = violation_sql("ms", "true", "missing_session", "advisory", "calendar")


@query("V8_calendar_coverage", sql(bars_sql(), CAL, select=V8))
def v8(spark, sf):
    b = bars(spark, sf)
    return flat(q.calendar_coverage(b, q.trading_calendar(b)))


VX = V7.replace("c < 300", "c < 252")


@query("V10_store_report", sql(bars_sql(), MOVES, CAL, "d AS (SELECT * FROM b)", f"va AS ({V1} UNION ALL {V2} UNION ALL {V3} UNION ALL " + violation_sql("mv", "m >= 0.25 AND m < 0.6", "extreme_return", "advisory", "return") + " UNION ALL " + violation_sql("mv", "m >= 0.6", "split_scale_return", "advisory", "return") + f" UNION ALL {VX} UNION ALL {V8})", select="SELECT \"check\", severity, count(*) AS symbols, CAST(sum(count) AS BIGINT) AS violations FROM va GROUP BY ALL"))
def v10(spark, sf):
    return q.report(files.written(bars(spark, sf), "bars")).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("symbols"), F.sum("count").alias("violations"))


@query("V11_ingest_gate", sql(bars_sql("day"), DIRTY, f"va AS ({V1})", select="SELECT symbol, count(*) AS rows, symbol NOT IN (SELECT symbol FROM va) AS accepted FROM d GROUP BY symbol"))
def v11(spark, sf):
    d = dirty(spark, sf)
    good, bad = q.gated(d, q.price_order(d))
    count = lambda x, ok: x.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).withColumn("accepted", F.lit(ok))
    return count(good, True).unionByName(count(bad, False))


@query("G35_store_status", sql(bars_sql(), CAL, GAPS, select="SELECT b.symbol, min(date) AS first, max(date) AS last, count(DISTINCT date) AS sessions, CAST(coalesce(any_value(missing), 0) AS BIGINT) AS missing, CAST(coalesce(any_value(longest), 0) AS BIGINT) AS longest FROM b LEFT JOIN gp ON b.symbol = gp.symbol GROUP BY b.symbol"))
def g35(spark, sf):
    b = bars(spark, sf)
    gaps = q.longest_gap(q.missing_sessions(b, q.trading_calendar(b)))
    return q.spans(b).join(gaps, "symbol", "left").select("symbol", "first", "last", "sessions", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("longest", F.lit(0)).alias("longest"))


@query("G36_quality_report", sql(bars_sql("day"), DIRTY, select="""SELECT *, stale_days > 10 AS stale, null_share < 0.1 AND stale_days <= 10 AS passed FROM (SELECT symbol, count(*) AS rows, min(date) AS first, max(date) AS last, count(*) FILTER (WHERE close IS NULL) AS null_close, count(*) - count(DISTINCT date) AS duplicates, count(*) FILTER (WHERE gap > 3) AS gaps,
 round(count(*) FILTER (WHERE close IS NULL) / (count(*) * 5), 6) AS null_share, date_diff('day', max(date), DATE '1998-12-01') AS stale_days FROM (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY symbol ORDER BY date), date) AS gap FROM d) GROUP BY symbol)"""))
def g36(spark, sf):
    d = q.quality(dirty(spark, sf), as_of="1998-12-01").withColumn("stale_days", F.date_diff(F.lit("1998-12-01").cast("date"), "last").cast("long"))
    return out(d.select("symbol", "rows", "first", "last", "null_close", "duplicates", "gaps", "null_share", "stale_days", "stale", "passed"))


@query("W33_filled_days", sql(bars_sql("day"), "sp AS (SELECT symbol, min(date) AS f, max(date) AS l FROM b GROUP BY symbol), dy AS (SELECT symbol, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS date FROM sp), wd AS (SELECT * FROM dy WHERE isodow(date) < 6)", select="SELECT wd.symbol, wd.date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY wd.symbol ORDER BY wd.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS close, coalesce(volume, 0) AS volume, close IS NULL AS filled FROM wd LEFT JOIN b ON b.symbol = wd.symbol AND b.date = wd.date"))
def w33(spark, sf):
    return out(q.filled_days(bars(spark, sf, "day").select("symbol", "date", "close", "volume")))


@query("P3_clean_rows", sql(bars_sql("day"), DIRTY, select="SELECT symbol, date, round(close,6) AS close FROM d WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"))
def p3(spark, sf):
    from crossgrain.functions.frames import finite

    d = dirty(spark, sf).withColumns({c: finite(F.col(c)) for c in ("open", "high", "low", "close")}).dropna(subset=["open", "high", "low", "close"])
    return out(d.select("symbol", "date", "close"))


@query("P4_first_symbols", "SELECT symbol FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem) ORDER BY symbol LIMIT 5")
def p4(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol")).distinct().orderBy("symbol").limit(5)


@query("P5_liquid_universe", sql(bars_sql(), select="SELECT symbol, count(*) AS sessions, round(avg(volume),6) AS mean_volume FROM b GROUP BY symbol HAVING count(*) >= 280 AND avg(volume) >= 40"))
def p5(spark, sf):
    d = bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"), F.avg("volume").alias("mean_volume"))
    return out(d.where("sessions >= 280 and mean_volume >= 40"))
