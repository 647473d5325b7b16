"""Queries over point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding
from crossgrain.operators import pit
from crossgrain.plans.common import out, sql
from crossgrain.plans.registry import query
from crossgrain.sources.bars import bars, bars_sql, table

STAYS = """ms AS (SELECT symbol, min(date) AS m FROM b GROUP BY symbol), sy AS (SELECT symbol, 'all' AS index_name, CAST(m + to_months(CAST(symbol AS INTEGER) % 12) AS DATE) AS start_date, CASE WHEN CAST(symbol AS INTEGER) % 3 = 0 THEN NULL ELSE CAST(m + to_months(CAST(symbol AS INTEGER) % 12 + 48) AS DATE) END AS end_date FROM ms)"""


def stays(spark, sf) -> DataFrame:
    """One stay per symbol, some of them open."""
    n = F.col("symbol").cast("int")
    m = bars(spark, sf, "month").groupBy("symbol").agg(F.min("date").alias("m"))
    return m.select("symbol", F.lit("all").alias("index_name"), F.add_months("m", n % 12).alias("start_date"), F.when(n % 3 != 0, F.add_months("m", n % 12 + 48)).alias("end_date"))


FACTS = """fq AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) * 0.6 AS cost_of_goods_sold FROM lineitem GROUP BY 1, 2),
 ff AS (SELECT symbol, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS fiscal_date, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY + to_days(30 + CAST(symbol AS INTEGER) % 30) AS DATE) AS report_date, revenue, cost_of_goods_sold, revenue * 0.1 AS net_income, sum(revenue) OVER w AS total_assets, sum(revenue) OVER w * 0.4 AS total_equity FROM fq WINDOW w AS (PARTITION BY symbol ORDER BY q))"""


def facts(spark, sf) -> DataFrame:
    """Quarterly facts per symbol, reported 30 to 59 days later."""
    from pyspark.sql import Window

    q = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q")).agg(F.sum("l_extendedprice").alias("revenue"), (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) * 0.6).alias("cost_of_goods_sold"))
    assets = F.sum("revenue").over(Window.partitionBy("symbol").orderBy("q"))
    end = F.date_sub(F.add_months("q", 3), 1)
    return q.select("symbol", end.alias("fiscal_date"), F.date_add(end, 30 + F.col("symbol").cast("int") % 30).alias("report_date"), "revenue", "cost_of_goods_sold", (F.col("revenue") * 0.1).alias("net_income"), assets.alias("total_assets"), (assets * 0.4).alias("total_equity"))


FLOATS = "fl AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, make_date(y, 1, 1) AS effective_date, 1e6 * (1 + s_suppkey % 50) * (1 + (y - 1992) / 10.0) AS free_float_shares, 1.5e6 * (1 + s_suppkey % 50) * (1 + (y - 1992) / 10.0) AS total_shares FROM supplier CROSS JOIN (SELECT CAST(unnest(range(1992, 1999)) AS INTEGER) AS y))"


def floats(spark, sf) -> DataFrame:
    years = spark.range(1992, 1999).select(F.col("id").cast("int").alias("y"))
    s = table(spark, sf, "supplier").crossJoin(F.broadcast(years))
    shares = 1e6 * (1 + F.col("s_suppkey") % 50) * (1 + (F.col("y") - 1992) / 10.0)
    return s.select(F.col("s_suppkey").cast("string").alias("symbol"), F.make_date("y", F.lit(1), F.lit(1)).alias("effective_date"), shares.alias("free_float_shares"), (shares * 1.5).alias("total_shares"))


SECTORS = "sc AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0)"


def sectors(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").where("s_suppkey % 10 <> 0")
    return s.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("n_name").alias("sector"))


@query("J1_membership_filter", sql(bars_sql("month"), STAYS, "bd AS (SELECT min(start_date) AS f, max(coalesce(end_date, DATE '9999-12-31')) AS t FROM sy)", select="SELECT symbol, date, round(close,6) AS close FROM b, bd WHERE NOT (date >= f AND date <= t) OR EXISTS (SELECT 1 FROM sy WHERE sy.symbol = b.symbol AND date >= start_date AND (end_date IS NULL OR date <= end_date))"))
def membership(spark, sf):
    return out(pit.apply_membership(bars(spark, sf, "month").select("symbol", "date", "close"), stays(spark, sf)))


@query("J2_members_on", sql(bars_sql("month"), STAYS, select="SELECT DISTINCT index_name, symbol FROM sy WHERE start_date <= DATE '1996-06-30' AND (end_date IS NULL OR end_date >= DATE '1996-06-30')"))
def members_on(spark, sf):
    return pit.members_on(stays(spark, sf), "1996-06-30")


@query("A6_checked_membership", sql(bars_sql("month"), STAYS, select="SELECT symbol, index_name, start_date, end_date, CASE WHEN end_date < start_date THEN 'ends_before_start' WHEN nx IS NOT NULL AND (end_date IS NULL OR nx <= end_date) THEN 'overlaps' END AS problem FROM (SELECT *, lead(start_date) OVER (PARTITION BY symbol, index_name ORDER BY start_date) AS nx FROM (SELECT * FROM sy UNION ALL SELECT symbol, index_name, CAST(start_date + to_days(1500) AS DATE), NULL FROM sy))"))
def checked_membership(spark, sf):
    s = stays(spark, sf)
    again = s.select("symbol", "index_name", F.date_add("start_date", 1500).alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return pit.checked_membership(s.unionByName(again))


@query("J3_facts_as_of", sql(FACTS, select="SELECT symbol, last(fiscal_date ORDER BY report_date) AS fiscal_date, last(report_date ORDER BY report_date) AS report_date, round(last(revenue ORDER BY report_date),4) AS revenue FROM ff WHERE report_date <= DATE '1996-09-30' GROUP BY symbol"))
def facts_as_of(spark, sf):
    d = pit.facts_as_of(facts(spark, sf), "1996-09-30")
    return d.select("symbol", "fiscal_date", "report_date", rounding("revenue", 4).alias("revenue"))


@query("J4_facts_on_dates", sql(bars_sql("month"), FACTS, select="SELECT b.symbol, b.date, round(f.net_income,4) net_income, round(f.total_equity,4) total_equity FROM b ASOF LEFT JOIN ff f ON b.symbol = f.symbol AND b.date >= f.report_date"))
def facts_on(spark, sf):
    d = pit.facts_on(bars(spark, sf, "month").select("symbol", "date"), facts(spark, sf), ["net_income", "total_equity"])
    return d.select("symbol", "date", rounding("net_income", 4).alias("net_income"), rounding("total_equity", 4).alias("total_equity"))


CAP = "cp AS (SELECT b.symbol, b.date, b.close, close * free_float_shares AS market_cap FROM b ASOF LEFT JOIN fl ON b.symbol = fl.symbol AND b.date >= fl.effective_date)"


@query("J5_market_cap", sql(bars_sql("month"), FLOATS, CAP, select="SELECT symbol, date, round(market_cap, 2) AS market_cap FROM cp"))
def market_cap(spark, sf):
    d = pit.market_cap(bars(spark, sf, "month").select("symbol", "date", "close"), floats(spark, sf))
    return d.select("symbol", "date", rounding("market_cap", 2).alias("market_cap"))


CURVE = "cv AS (SELECT CAST(m AS DATE) AS date, 6.0 + (row_number() OVER (ORDER BY m) - 1) * 0.01 AS y FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01'))"


@query("J6_risk_free", sql(bars_sql(), CURVE, "dt AS (SELECT DISTINCT date FROM b)", select="SELECT dt.date, round(pow(1 + coalesce(cv.y, (SELECT min(y) FROM cv)) / 100, 1 / 252.0) - 1, 9) AS daily_rate FROM dt ASOF LEFT JOIN cv ON dt.date >= cv.date"))
def risk_free(spark, sf):
    from pyspark.sql import Window

    m = table(spark, sf, "orders").where("o_orderdate >= timestamp '1993-01-01'").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).distinct()
    curve = m.select("date", (6.0 + (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1) * 0.01).alias("annualized_yield"))
    return pit.daily_risk_free(bars(spark, sf).select("date"), curve).select("date", rounding("daily_rate", 9).alias("daily_rate"))


@query("J8_sectors", sql(bars_sql("month"), SECTORS, select="SELECT b.symbol, b.date, coalesce(sector, 'UNKNOWN') AS sector FROM b LEFT JOIN sc USING (symbol)"))
def sector_lookup(spark, sf):
    return pit.sectors_of(bars(spark, sf, "month").select("symbol", "date"), sectors(spark, sf)).select("symbol", "date", "sector")


@query("J8_unmapped_symbols", sql(bars_sql("month"), SECTORS, select="SELECT DISTINCT symbol FROM b WHERE symbol NOT IN (SELECT symbol FROM sc)"))
def unmapped(spark, sf):
    return bars(spark, sf, "month").select("symbol").distinct().join(sectors(spark, sf), "symbol", "left_anti")


@query("W36_characteristics", sql(bars_sql("month"), FACTS, FLOATS, CAP, "ch AS (SELECT cp.symbol, cp.date, cp.market_cap, f.* EXCLUDE (symbol) FROM cp ASOF LEFT JOIN ff f ON cp.symbol = f.symbol AND cp.date >= f.report_date)", select="SELECT symbol, date, round(CASE WHEN market_cap > 0 THEN total_equity / market_cap END, 9) AS book_to_price, round(CASE WHEN market_cap > 0 THEN net_income / market_cap END, 9) AS earnings_to_price, round(CASE WHEN total_assets > 0 THEN (revenue - cost_of_goods_sold) / total_assets END, 6) AS gross_profitability, round(CASE WHEN lag(total_assets, 12) OVER w > 0 THEN total_assets / lag(total_assets, 12) OVER w END - 1, 6) AS asset_growth FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY date)"))
def characteristics(spark, sf):
    cap = pit.market_cap(bars(spark, sf, "month").select("symbol", "date", "close"), floats(spark, sf))
    d = pit.facts_on(cap, facts(spark, sf), ["total_equity", "net_income", "revenue", "cost_of_goods_sold", "total_assets"])
    d = pit.characteristics(d, year=12)
    return d.select("symbol", "date", rounding("book_to_price", 9).alias("book_to_price"), rounding("earnings_to_price", 9).alias("earnings_to_price"), rounding("gross_profitability", 6).alias("gross_profitability"), rounding("asset_growth", 6).alias("asset_growth"))


@query("V12_fundamentals_report", sql(FACTS, select="SELECT count(*) AS rows, count(*) FILTER (WHERE lag < 0) AS negative_lag, count(*) FILTER (WHERE lag < 15) AS short_lag, count(*) FILTER (WHERE lag > 120) AS long_lag, count(*) FILTER (WHERE again > 1) AS repeated, min(lag) = max(lag) AS same_lag, CAST(median(lag) AS DOUBLE) AS median_lag FROM (SELECT date_diff('day', fiscal_date, report_date) AS lag, count(*) OVER (PARTITION BY symbol, fiscal_date) AS again FROM ff)"))
def fundamentals_report(spark, sf):
    return pit.fundamentals_report(facts(spark, sf))


@query("V13_float_report", sql(FLOATS, select="SELECT count(*) AS rows, count(*) FILTER (WHERE free_float_shares <= 0) AS non_positive, count(*) FILTER (WHERE free_float_shares > total_shares) AS beyond_issued, count(*) FILTER (WHERE free_float_shares / total_shares < 0.05) AS tiny, round(median(free_float_shares / total_shares), 6) AS median_share FROM fl"))
def float_report(spark, sf):
    return out(pit.float_report(floats(spark, sf)))
