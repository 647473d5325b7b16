"""Checks of bars and reference tables. A check gives rows (check, severity, symbol, count, detail, examples)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.frames import own

STRUCTURAL, ADVISORY = "structural", "advisory"


def _violations(rows: DataFrame, check: str | Column, severity: str, detail: str | Column, count: Column | None = None) -> DataFrame:
    """A row per symbol (and check, where that is a column) with the first three dates as examples; the dates are ordered, not gathered without bound."""
    named = rows.withColumns({"_check": F.lit(check), "_detail": F.lit(detail)})
    first = Window.partitionBy("symbol", "_check").orderBy("date")
    d = named.withColumn("_n", F.row_number().over(first))
    out = d.groupBy("symbol", "_check", "_detail").agg((count if count is not None else F.count(F.lit(1))).alias("count"), F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.col("date").cast("string")))).alias("examples"))
    return out.select(F.col("_check").alias("check"), F.lit(severity).alias("severity"), "symbol", F.col("count").cast("long").alias("count"), F.col("_detail").alias("detail"), "examples")


def _all_violations(bars: DataFrame, severity: str, cases: dict[str, tuple[Column, str]]) -> DataFrame:
    """The violations of several checks {name: (what is wrong, detail)} of single rows, in one pass."""
    hits = F.array(*[F.when(wrong, F.struct(F.lit(k).alias("check"), F.lit(detail).alias("detail"))) for k, (wrong, detail) in cases.items()])
    rows = bars.select("symbol", "date", F.explode(F.array_compact(hits)).alias("_hit"))
    return _violations(rows, F.col("_hit.check"), severity, F.col("_hit.detail"))


def price_order(bars: DataFrame) -> DataFrame:
    """High under the body, low over it, high under low, beyond 1e-9 of the body."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    slack = 1e-9 * F.greatest(F.abs(top), F.lit(1.0))
    cases = {"high_below_body": F.col("high") < top - slack, "low_above_body": F.col("low") > bottom + slack, "high_below_low": F.col("high") < F.col("low") - slack}
    return _all_violations(bars, STRUCTURAL, {k: (c, "order of prices") for k, c in cases.items()})


def positive_prices(bars: DataFrame) -> DataFrame:
    """Prices that are missing or not positive, per leg; negative volumes."""
    legs = {f"non_positive_{c}": (F.coalesce(F.col(c), F.lit(0.0)) <= 0, c) for c in ("open", "high", "low", "close")}
    return _all_violations(bars, STRUCTURAL, legs | {"negative_volume": (F.col("volume") < 0, "volume")})


def duplicate_dates(bars: DataFrame) -> DataFrame:
    """Rows beyond the first of a symbol and date."""
    d = bars.groupBy("symbol", "date").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")
    return _violations(d, "duplicate_date", STRUCTURAL, "date", F.sum("extra"))


def unsorted(bars: DataFrame, sequence: str) -> DataFrame:
    """Rows whose date is before that of the row ingested before."""
    d = bars.withColumn("_before", F.lag("date").over(own(order=sequence)))
    return _violations(d.where("_before > date"), "unsorted", STRUCTURAL, "order of dates")


def extreme_returns(bars: DataFrame, extreme: float = 0.25, split: float = 0.60) -> DataFrame:
    """Moves of 25% and more, and, apart, those of the size of a split."""
    d = bars.withColumn("_m", F.abs(F.try_divide(F.col("close"), F.lag("close").over(own())) - 1))
    return _violations(d.where((F.col("_m") >= extreme) & (F.col("_m") < split)), "extreme_return", ADVISORY, "return").unionByName(_violations(d.where(F.col("_m") >= split), "split_scale_return", ADVISORY, "return"))


def unexplained_factor(bars: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The adjustment factor moved and no action says why."""
    d = bars.withColumn("_f", F.abs(F.try_divide(F.col("adj_factor"), F.lag("adj_factor").over(own())) - 1))
    none = (F.coalesce(F.col("stock_splits"), F.lit(0.0)) == 0) & (F.coalesce(F.col("dividends"), F.lit(0.0)) == 0)
    return _violations(d.where((F.col("_f") > tolerance) & none), "unexplained_factor", ADVISORY, "adj_factor")


def short_history(bars: DataFrame, least: int = 252) -> DataFrame:
    d = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("date")).where(F.col("n") < least)
    return _violations(d, "short_history", ADVISORY, "sessions", F.max("n"))


def spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("sessions"))


def trading_calendar(bars: DataFrame, share: float = 0.6) -> DataFrame:
    """Dates on which at least ``share`` of the symbols whose span covers them traded, where there are two symbols or more.

    The number of spans that cover a date is a running sum of starts and ends: no range join.
    """
    s = spans(bars)
    steps = s.select(F.col("first").alias("date"), F.lit(1).alias("step")).unionAll(s.select(F.date_add("last", 1).alias("date"), F.lit(-1).alias("step")))
    traded = bars.select("date", "symbol").distinct().groupBy("date").agg(F.count(F.lit(1)).alias("traded"))
    moves = steps.groupBy("date").agg(F.sum("step").alias("step"))
    d = moves.join(traded, "date", "full").withColumn("alive", F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("date")))
    return d.where((F.col("alive") >= 2) & (F.col("traded") >= share * F.col("alive"))).select("date")


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, date, position): calendar dates within a symbol's span without a bar; the calendar is one row per date."""
    c = calendar.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    inside = F.broadcast(c).join(spans(bars), (F.col("date") >= F.col("first")) & (F.col("date") <= F.col("last"))).select("symbol", "date", "position")
    return inside.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti")


def longest_gap(missing: DataFrame) -> DataFrame:
    """(symbol, missing, longest): runs of neighbouring missing sessions are islands of position less row number."""
    island = F.col("position") - F.row_number().over(Window.partitionBy("symbol").orderBy("position"))
    runs = missing.withColumn("_island", island).groupBy("symbol", "_island").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy("symbol").agg(F.sum("run").alias("missing"), F.max("run").alias("longest"))


def calendar_coverage(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    return _violations(missing_sessions(bars, calendar), "missing_session", ADVISORY, "calendar")


def report(bars: DataFrame, *, sequence: str | None = None, least_history: int = 252) -> DataFrame:
    """All checks of a store."""
    parts = [price_order(bars), positive_prices(bars), duplicate_dates(bars), extreme_returns(bars), short_history(bars, least_history), calendar_coverage(bars, trading_calendar(bars))]
    if sequence:
        parts.append(unsorted(bars, sequence))
    if "adj_factor" in bars.columns:
        parts.append(unexplained_factor(bars))
    return reduce(DataFrame.unionByName, parts)


def gated(bars: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): symbols with a structural violation are set apart whole."""
    bad = violations.where(F.col("severity") == STRUCTURAL).select("symbol").distinct()
    return bars.join(bad, "symbol", "left_anti"), bars.join(bad, "symbol", "left_semi")


def quality(bars: DataFrame, *, as_of: str, stale_days: int = 10, most_null: float = 0.10) -> DataFrame:
    """Per symbol: rows, span, nulls, duplicates, idle days, gaps over three days, staleness and the gate."""
    gap = F.date_diff("date", F.lag("date").over(own()))
    legs = ("open", "high", "low", "close", "volume")
    d = bars.withColumn("_gap", gap).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in legs],
        (F.count(F.lit(1)) - F.count_distinct("date")).alias("duplicates"), F.count_if(F.col("volume") == 0).alias("idle"), F.count_if(F.col("_gap") > 3).alias("gaps"),
    )
    stale = F.date_diff(F.lit(as_of).cast("date"), "last") > stale_days
    nulls = sum((F.col(f"null_{c}") for c in legs), F.lit(0)) / (F.col("rows") * len(legs))
    return d.withColumns({"null_share": nulls, "stale": stale, "passed": (nulls < most_null) & ~stale})


def filled_days(bars: DataFrame, most: int = 3) -> DataFrame:
    """Every weekday of a symbol's span; gaps take the last close for at most ``most`` days, with no volume."""
    s = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = s.select("symbol", F.explode(F.sequence("first", "last")).alias("date")).where(F.weekday("date") < 5)
    w = own().rowsBetween(-most, 0)
    d = days.join(bars, ["symbol", "date"], "left")
    return d.select("symbol", "date", F.last("close", ignorenulls=True).over(w).alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.col("close").isNull().alias("filled"))
