"""Point-in-time joins: membership intervals, facts known at a date, step functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.frames import as_of, across, own

MEMBERSHIP = "symbol string, index_name string, start_date date, end_date date"
FACTS = ("total_assets", "total_equity", "revenue", "cost_of_goods_sold", "operating_income", "net_income", "total_debt", "cash_flow_operating", "shares_outstanding")


def checked_membership(rows: DataFrame) -> DataFrame:
    """``rows`` with ``problem``: what is wrong with a stay, null if nothing."""
    w = Window.partitionBy("symbol", "index_name").orderBy("start_date")
    following = F.lead("start_date").over(w)
    problem = F.when(F.coalesce(F.trim("symbol"), F.lit("")) == "", "no_symbol").when(F.col("start_date").isNull(), "no_start").when(F.col("end_date") < F.col("start_date"), "ends_before_start")
    problem = problem.when(following.isNotNull() & (F.col("end_date").isNull() | (following <= F.col("end_date"))), "overlaps")
    return rows.withColumn("problem", problem)


def apply_membership(panel: DataFrame, stays: DataFrame) -> DataFrame:
    """Rows whose symbol was a member on the date; dates outside the table's own coverage stay.

    An interval semi-join by symbol; stays are few per symbol, so the equi-join on symbol carries it.
    """
    bounds = stays.agg(F.min("start_date").alias("_from"), F.max(F.coalesce("end_date", F.lit("9999-12-31").cast("date"))).alias("_to"))
    d = panel.crossJoin(F.broadcast(bounds))  # one row
    inside = F.coalesce((F.col("date") >= F.col("_from")) & (F.col("date") <= F.col("_to")), F.lit(False))
    s = stays.select(F.col("symbol").alias("_symbol"), "start_date", "end_date")
    member = (F.col("symbol") == F.col("_symbol")) & (F.col("date") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("date") <= F.col("end_date")))
    return d.where(inside).join(s, member, "left_semi").unionByName(d.where(~inside)).drop("_from", "_to")


def members_on(stays: DataFrame, date: str) -> DataFrame:
    at = F.lit(date).cast("date")
    return stays.where((F.col("start_date") <= at) & (F.col("end_date").isNull() | (F.col("end_date") >= at))).select("index_name", "symbol").distinct()


def first_reports(facts: DataFrame) -> DataFrame:
    """The first report of every fiscal period; restatements are left out."""
    w = Window.partitionBy("symbol", "fiscal_date").orderBy("report_date")
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def facts_as_of(facts: DataFrame, date: str) -> DataFrame:
    """The latest known report of every symbol at one date."""
    known = first_reports(facts).where(F.col("report_date") <= F.lit(date).cast("date"))
    return known.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in known.columns if c != "symbol"]), F.struct("report_date", "fiscal_date")).alias("r")).select("symbol", "r.*")


def facts_on(grid: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Every grid row with the latest non-null value of each fact by report date."""
    return as_of(grid, first_reports(facts), columns, at="report_date")


def market_cap(bars: DataFrame, floats: DataFrame) -> DataFrame:
    """Close times the free float in force."""
    w = Window.partitionBy("symbol", "effective_date").orderBy(F.desc("free_float_shares"))
    last = floats.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return as_of(bars, last, ["free_float_shares"], at="effective_date").withColumn("market_cap", F.col("close") * F.col("free_float_shares"))


def daily_risk_free(dates: DataFrame, curve: DataFrame, per_year: int = 252) -> DataFrame:
    """The curve on every date, filled forward and, before its start, back; percent is told by a value over 1."""
    scale = curve.agg(F.when(F.max(F.abs("annualized_yield")) > 1, 100.0).otherwise(1.0).alias("_scale"))
    c = curve.crossJoin(F.broadcast(scale)).select(F.lit(0).alias("_k"), "date", (F.col("annualized_yield") / F.col("_scale")).alias("y"))
    d = as_of(dates.select("date").distinct().withColumn("_k", F.lit(0)), c, ["y"], at="date", key="_k")
    w = Window.partitionBy("_k").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    return d.withColumn("y", F.coalesce("y", F.first("y", ignorenulls=True).over(w))).select("date", (F.pow(1 + F.col("y"), 1.0 / per_year) - 1).alias("daily_rate"))


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is not positive."""
    return F.when(b > 0, a / F.when(b > 0, b))


def characteristics(panel: DataFrame, *, year: int = 252) -> DataFrame:
    """Valuation and quality ratios of rows that carry lagged facts and ``market_cap``."""
    growth = safe_ratio(F.col("total_assets"), F.lag("total_assets", year).over(own())) - 1
    return panel.withColumns(
        {
            "book_to_price": safe_ratio(F.col("total_equity"), F.col("market_cap")),
            "earnings_to_price": safe_ratio(F.col("net_income"), F.col("market_cap")),
            "gross_profitability": safe_ratio(F.col("revenue") - F.col("cost_of_goods_sold"), F.col("total_assets")),
            "asset_growth": growth,
        }
    )


def sectors_of(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """``sector`` of every symbol, UNKNOWN where there is none; of repeated lines the last counts."""
    return rows.join(sectors.select("symbol", "sector"), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))


def fundamentals_report(facts: DataFrame) -> DataFrame:
    """One row of counts: lags that are negative, short or long, repeated periods, facts given, the median lag."""
    lag = F.date_diff("report_date", "fiscal_date")
    periods = Window.partitionBy("symbol", "fiscal_date")
    d = facts.withColumns({"lag": lag, "again": F.count(F.lit(1)).over(periods)})
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("lag") < 0).alias("negative_lag"), F.count_if(F.col("lag") < 15).alias("short_lag"), F.count_if(F.col("lag") > 120).alias("long_lag"), F.count_if(F.col("again") > 1).alias("repeated"), (F.min("lag") == F.max("lag")).alias("same_lag"), F.percentile("lag", 0.5).alias("median_lag"))


def float_report(floats: DataFrame) -> DataFrame:
    share = safe_ratio(F.col("free_float_shares"), F.col("total_shares"))
    d = floats.withColumn("share", share)
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("free_float_shares") <= 0).alias("non_positive"), F.count_if(F.col("free_float_shares") > F.col("total_shares")).alias("beyond_issued"), F.count_if(F.col("share") < 0.05).alias("tiny"), F.percentile("share", 0.5).alias("median_share"))


def zscored(panel: DataFrame, columns: list[str], *, min_names: int = 5, clip: float = 10.0) -> DataFrame:
    """Cross-sectional z-scores: no spread is 0, unknown is 0, thin dates go."""
    w = across("date")
    d = panel.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= min_names).drop("_n")
    out = {}
    for c in columns:
        sd = F.stddev_pop(c).over(w)
        z = F.when(sd > 0, (F.col(c) - F.avg(c).over(w)) / F.when(sd > 0, sd)).otherwise(0.0)
        out[f"{c}_z"] = F.coalesce(F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))), F.lit(0.0))
    return d.withColumns(out)


def residual(panel: DataFrame, x: str, y: str = "score", *, group: str | None = None) -> DataFrame:
    """What is left of ``y`` per date after a regression on one exposure and, demeaned first, group membership."""
    if group:
        g = across("date", group)
        panel = panel.withColumns({"_y": F.col(y) - F.avg(y).over(g), "_x": F.col(x) - F.avg(x).over(g)})
    else:
        panel = panel.withColumns({"_y": F.col(y), "_x": F.col(x)})
    w = across("date")
    slope = F.try_divide(F.covar_pop("_x", "_y").over(w), F.var_pop("_x").over(w))
    return panel.withColumn("residual", F.col("_y") - F.avg("_y").over(w) - F.coalesce(slope, F.lit(0.0)) * (F.col("_x") - F.avg("_x").over(w))).drop("_x", "_y")
