"""How good a score is: rank correlation, buckets, decay, costs. All on panels (date, symbol, score, forward_return)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.frames import across, average_rank, bucket, finite, percentile_rank
from crossgrain.sources import files

MIN_NAMES = 5


def ratio(a: Column, b: Column) -> Column:
    """0/0 is 0, x/0 an infinity of x's sign."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a == 0, 0.0).when(a > 0, float("inf")).when(a < 0, float("-inf"))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; null where a side does not vary."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def validated(panel: DataFrame, columns: Sequence[str] = ("score", "forward_return")) -> DataFrame:
    """Rows whose numbers are all finite."""
    return panel.withColumns({c: finite(F.col(c)) for c in columns}).dropna(subset=list(columns))


def without_absurd_labels(panel: DataFrame, most: float = 5.0, column: str = "forward_return") -> DataFrame:
    """Rows whose label is at most ``most`` in size; rows without a label stay."""
    return panel.where(F.coalesce(F.abs(F.col(column)) <= most, F.lit(True)))


def rank_ic(panel: DataFrame, *keys: str, min_names: int = MIN_NAMES, label: str = "forward_return", score: str = "score") -> DataFrame:
    """(keys, ic, names): Spearman correlation per date; dates of few names or of one value on a side have none."""
    keys = keys or ("date",)
    ranked = panel.select(*keys, average_rank(score, *keys).alias("a"), average_rank(label, *keys).alias("b"))
    out = ranked.groupBy(*keys).agg(correlation("a", "b").alias("ic"), F.count(F.lit(1)).alias("names"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    return out.where((F.col("names") >= min_names) & (F.col("a0") < F.col("a1")) & (F.col("b0") < F.col("b1"))).select(*keys, "ic", "names")


def rank_ics(panel: DataFrame, scores: Sequence[str], *, min_names: int = MIN_NAMES, label: str = "forward_return") -> DataFrame:
    """(date, ic_<score>, ...) of the dates that ``rank_ic`` has for all of ``scores``; the label is ranked once."""
    ranked = panel.select("date", average_rank(label).alias("_b"), *[average_rank(s).alias(s) for s in scores])
    ends = [f(c).alias(f"_{k}_{c}") for c in ("_b", *scores) for k, f in (("low", F.min), ("high", F.max))]
    out = ranked.groupBy("date").agg(F.count(F.lit(1)).alias("_n"), *ends, *[correlation(s, "_b").alias(f"ic_{s}") for s in scores]).where(F.col("_n") >= min_names)
    for c in ("_b", *scores):
        out = out.where(F.col(f"_low_{c}") < F.col(f"_high_{c}"))
    return out.select("date", *[f"ic_{s}" for s in scores])


def placed(panel: DataFrame, label: str, into: str = "place") -> DataFrame:
    """Adds the label's rank among its date's rows, ties averaged, less the middle rank."""
    return panel.withColumn(into, average_rank(label) - (F.count(F.lit(1)).over(across("date")) + 1) / 2)


def place_ic(panel: DataFrame, *keys: str, score: str = "score", place: str = "place", min_names: int = MIN_NAMES) -> DataFrame:
    """``rank_ic`` of whole dates whose labels are ``placed``: equal scores of a date are one row before anything is put in order."""
    keys = keys or ("date",)
    d = panel.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(place).alias("_s"), F.sum(F.col(place) * F.col(place)).alias("_ss"))
    upto = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_a", F.sum("_n").over(upto) - (F.col("_n") - 1) / 2 - (F.sum("_n").over(across(*keys)) + 1) / 2)
    sums = [F.sum("_n").alias("names"), F.count(F.lit(1)).alias("_values"), F.sum(F.col("_a") * F.col("_s")).alias("_c"), F.sum(F.col("_n") * F.col("_a") * F.col("_a")).alias("_aa"), F.sum("_ss").alias("_bb")]
    out = d.groupBy(*keys).agg(*sums).where((F.col("names") >= min_names) & (F.col("_values") > 1) & (F.col("_bb") > 0))
    return out.select(*keys, (F.col("_c") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias("ic"), "names")


def newey_west(series: DataFrame, lags: int, *keys: str, order: str = "date", value: str = "ic") -> DataFrame:
    """(keys, n, mean, sd, se): the standard error of a mean with Bartlett weights; denominators n, a negative variance is 0.

    ``series`` has one row per date and key, so its windows are small.
    """
    group = list(keys)
    w = Window.partitionBy(*group).orderBy(order) if group else Window.partitionBy(F.lit(0)).orderBy(order)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    d = series.select(*group, order, F.col(value).alias("_v")).withColumn("_d", F.col("_v") - F.avg("_v").over(whole))
    products = {f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)}
    d = d.withColumns(products) if products else d
    aggs = [F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("sd"), F.sum(F.col("_d") * F.col("_d")).alias("_p0"), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_p{k}") for k in range(1, lags + 1)]]
    out = d.groupBy(*group).agg(*aggs)
    n = F.col("n")
    variance = F.col("_p0") / n
    for k in range(1, lags + 1):
        variance = variance + F.when(n > k, 2 * (1 - k / (F.least(F.lit(lags), n - 1) + 1.0)) * F.col(f"_p{k}") / n).otherwise(0.0)
    return out.select(*group, "n", "mean", "sd", F.sqrt(F.greatest(variance, F.lit(0.0)) / n).alias("se"))


def ic_summary(ics: DataFrame, lags: int, *keys: str) -> DataFrame:
    """(keys, dates, mean_ic, sd_ic, icir, t, positive_share)."""
    nw = newey_west(ics, lags, *keys)
    share = ics.groupBy(*keys).agg(F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive_share"))
    joined = nw.join(share, list(keys)) if keys else nw.crossJoin(share)
    return joined.select(*keys, F.col("n").alias("dates"), F.col("mean").alias("mean_ic"), F.col("sd").alias("sd_ic"), ratio(F.col("mean"), F.col("sd")).alias("icir"), ratio(F.col("mean"), F.col("se")).alias("t"), "positive_share")


def overlap_lags(horizon: int, stride: int) -> int:
    """Neighbouring labels that share returns."""
    return max(0, -(-horizon // stride) - 1)


def bucketed(panel: DataFrame, buckets: int, *keys: str, least: int = MIN_NAMES) -> DataFrame:
    """Rows of dates with names enough, with ``bucket``."""
    keys = keys or ("date",)
    d = panel.withColumn("bucket", bucket("score", buckets, *keys)).withColumn("_n", F.count(F.lit(1)).over(across(*keys)))
    return d.where(F.col("_n") >= max(least, buckets)).drop("_n")


def bucket_returns(panel: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """(keys but date, bucket, mean_return, dates): means per date, then over dates alike."""
    groups = [k for k in keys if k != "date"]
    daily = bucketed(panel, buckets, *groups, "date").groupBy(*groups, "date", "bucket").agg(F.avg("forward_return").alias("r"))
    return daily.groupBy(*groups, "bucket").agg(F.avg("r").alias("mean_return"), F.count(F.lit(1)).alias("dates"))


def bucket_summary(panel: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """(keys, spread, monotonicity, rising_share) of the occupied buckets."""
    groups = [k for k in keys if k != "date"]
    d = bucket_returns(panel, buckets, *keys)
    part = groups or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("bucket")
    rank = F.rank().over(Window.partitionBy(*part).orderBy("mean_return")) + (F.count(F.lit(1)).over(Window.partitionBy(*part, "mean_return")) - 1) / 2
    d = d.withColumns({"_rank": rank, "_step": (F.col("mean_return") > F.lag("mean_return").over(w)).cast("double")})
    return d.groupBy(*groups).agg((F.max_by("mean_return", "bucket") - F.min_by("mean_return", "bucket")).alias("spread"), correlation("bucket", "_rank").alias("monotonicity"), F.avg("_step").alias("rising_share"))


def hit_rate(panel: DataFrame, *keys: str) -> DataFrame:
    """Share of rows on the same side of the date's median score and mean return; scores at the median are not graded."""
    groups = [k for k in keys if k != "date"]
    w = across(*groups, "date")
    d = panel.withColumns({"_s": F.signum(F.col("score") - F.percentile("score", 0.5).over(w)), "_r": F.signum(F.col("forward_return") - F.avg("forward_return").over(w)), "_flat": F.min("score").over(w) == F.max("score").over(w)})
    return d.where("not _flat and _s <> 0").groupBy(*groups).agg(F.avg((F.col("_s") == F.col("_r")).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("graded"))


def spread_quantiles(rows: DataFrame, quantiles: Sequence[float], slices: int = 1 << 16) -> DataFrame:
    """(bucket, q, value): exact quantiles of ``e``, -1 to 1, by ``bucket`` and over all (null), interpolated; ``rows`` are read twice.

    Counts of equal slices of the range tell in which slices the places lie; only their values are put in order, equal
    ones as one. No task sees more than its part of a slice.
    """
    d = rows.select("bucket", "e", F.floor((F.col("e") + 1) * (slices / 2)).alias("slice"))
    counts = d.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(counts.groupBy("slice").agg(F.sum("n").alias("n")).withColumn("bucket", F.lit(None).cast("long")))
    own = Window.partitionBy("bucket")
    upto = own.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"below": F.sum("n").over(upto) - F.col("n"), "all": F.sum("n").over(own)})
    places = counts.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn("at", F.col("q") * (F.col("all") - 1))
    ends = places.withColumn("place", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    wanted = ends.where("place >= below and place < below + n").select("bucket", "q", "at", "place", "slice", "below")
    slim = d.join(F.broadcast(wanted.select("slice").distinct()), "slice", "left_semi").groupBy("bucket", "slice", "e").agg(F.count(F.lit(1)).alias("m"))
    slim = slim.unionByName(slim.groupBy("slice", "e").agg(F.sum("m").alias("m")).withColumn("bucket", F.lit(None).cast("long")))
    first = F.sum("m").over(Window.partitionBy("bucket", "slice").orderBy("e").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    valued = slim.withColumn("first", first).alias("v")
    w = F.broadcast(wanted).alias("w")
    inside = (F.col("w.place") - F.col("w.below") >= F.col("first")) & (F.col("w.place") - F.col("w.below") < F.col("first") + F.col("m"))
    found = valued.join(w, F.col("v.bucket").eqNullSafe(F.col("w.bucket")) & (F.col("v.slice") == F.col("w.slice")) & inside)
    ends = found.groupBy("w.bucket", "q", "at").agg(F.min_by("e", "place").alias("low"), F.max_by("e", "place").alias("high"))
    value = F.when(F.floor("at") == F.ceil("at"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    return ends.select("bucket", "q", value.alias("value"))


def rank_errors(panel: DataFrame, buckets: int) -> DataFrame:
    """Percentile of the score less that of the return: its size, quantiles and count by bucket (null: all)."""
    d = files.written(bucketed(panel, buckets).select("bucket", (percentile_rank("score") - percentile_rank("forward_return")).alias("e")), "errors")
    stats = [F.avg(F.abs("e")).alias("mean_abs_error"), F.count(F.lit(1)).alias("rows")]
    sizes = d.groupBy("bucket").agg(*stats).unionByName(d.agg(*stats).withColumn("bucket", F.lit(None).cast("long")))
    steps = (5, 25, 50, 75, 95)
    wide = spread_quantiles(d, [q / 100 for q in steps]).groupBy("bucket").agg(*[F.max(F.when(F.col("q") == q / 100, F.col("value"))).alias(f"p{q}") for q in steps])
    joined = sizes.alias("s").join(wide.alias("v"), F.col("s.bucket").eqNullSafe(F.col("v.bucket")), "left")
    return joined.select("s.bucket", "mean_abs_error", "rows", *[f"p{q}" for q in steps])


def score_dispersion(panel: DataFrame) -> DataFrame:
    """Mean over dates of distinct scores over names."""
    return panel.groupBy("date").agg((F.count_distinct("score") / F.count("score")).alias("d")).agg(F.avg("d").alias("dispersion"))


def decay(panel: DataFrame, horizons: Sequence[int], *, min_names: int = MIN_NAMES) -> DataFrame:
    """(horizon, mean_ic, dates, t) from columns ``forward_return_<h>``; all horizons in one pass."""
    pairs = ", ".join(f"{h}, forward_return_{h}" for h in horizons)
    long = panel.selectExpr("date", "symbol", "score", f"stack({len(horizons)}, {pairs}) as (horizon, forward_return)")
    ics = rank_ic(validated(long), "horizon", "date", min_names=min_names)
    parts = [newey_west(ics.where(F.col("horizon") == h), overlap_lags(h, 1), "horizon") for h in horizons]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("horizon").cast("long").alias("horizon"), F.col("mean").alias("mean_ic"), F.col("n").alias("dates"), ratio(F.col("mean"), F.col("se")).alias("t"))


def half_life(table: DataFrame) -> DataFrame:
    """(peak_horizon, peak_ic, half_life): the horizon, interpolated, at which the size of the IC first falls to half its peak after the peak."""
    peak = table.orderBy(F.abs("mean_ic").desc(), "horizon").limit(1).select(F.col("horizon").alias("peak_horizon"), F.col("mean_ic").alias("peak_ic"))
    w = Window.partitionBy(F.lit(0)).orderBy("horizon")
    sign = F.signum("peak_ic")
    d = table.crossJoin(F.broadcast(peak)).withColumns({"v": F.col("mean_ic") * sign, "half": F.abs("peak_ic") / 2}).where("horizon >= peak_horizon")
    d = d.withColumns({"v0": F.lag("v").over(w), "h0": F.lag("horizon").over(w)})
    cross = d.where("v0 > half and v <= half").orderBy("horizon").limit(1).select((F.col("h0") + (F.col("v0") - F.col("half")) / (F.col("v0") - F.col("v")) * (F.col("horizon") - F.col("h0"))).alias("half_life"))
    return peak.join(cross, F.lit(True), "left")


def bucket_members(panel: DataFrame, buckets: int, at: int | None = None) -> DataFrame:
    """(date, symbol) of the names in a bucket, the top one if not said."""
    return bucketed(panel, buckets).where(F.col("bucket") == (buckets - 1 if at is None else at)).select("date", "symbol")


def turnover(members: DataFrame, hold: int = 1) -> DataFrame:
    """(date, turnover, names): names held that were not held ``hold`` rebalances before; the first ``hold`` dates have none."""
    dates = members.select("date").distinct()
    dates = dates.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    m = members.join(F.broadcast(dates), "date")
    old = m.select("symbol", (F.col("r") + hold).alias("r"), F.lit(1).alias("was"))
    d = m.join(old, ["symbol", "r"], "left").where(F.col("r") > hold)
    return d.groupBy("date").agg(F.avg(F.when(F.col("was").isNull(), 1.0).otherwise(0.0)).alias("turnover"), F.count(F.lit(1)).alias("names"))


def net_spread(panel: DataFrame, buckets: int, *, round_trip: float, stride: int, hold: int = 1, per_year: int = 252) -> DataFrame:
    """One row: gross and net spread per period and year, break-even cost, the share that costs take; two legs and long only."""
    spread = bucket_summary(panel, buckets).select("spread")
    daily = bucketed(panel, buckets).groupBy("date", "bucket").agg(F.avg("forward_return").alias("r"))
    top = daily.where(F.col("bucket") == buckets - 1).agg(F.avg("r").alias("long_gross"))
    turn = turnover(bucket_members(panel, buckets), hold).agg(F.avg("turnover").alias("turnover"), F.count(F.lit(1)).alias("rebalances"))
    d = spread.crossJoin(top).crossJoin(turn)
    cost = F.col("turnover") * round_trip
    year = per_year / stride
    return d.select(
        F.col("spread").alias("gross"), "turnover", "rebalances", (F.col("spread") - 2 * cost).alias("net"), (F.col("long_gross") - cost).alias("long_only_net"),
        F.try_divide(F.col("spread"), 2 * F.col("turnover")).alias("break_even"), ((F.col("spread") - 2 * cost) * year).alias("net_per_year"), F.try_divide(2 * cost, F.abs(F.col("spread"))).alias("cost_share"),
    )


def evaluated(panel: DataFrame, *, buckets: int, lags: int, min_names: int = MIN_NAMES) -> DataFrame:
    """One row per ``strategy``: rank correlation, buckets, hit rate, dispersion and counts; best mean first."""
    ics = rank_ic(panel, "strategy", "date", min_names=min_names)
    counts = panel.groupBy("strategy").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("all_dates"), F.count_distinct("symbol").alias("symbols"))
    spread = panel.groupBy("strategy", "date").agg((F.count_distinct("score") / F.count("score")).alias("d")).groupBy("strategy").agg(F.avg("d").alias("dispersion"))
    out = counts.join(ic_summary(ics, lags, "strategy"), "strategy", "left").join(bucket_summary(panel, buckets, "strategy", "date"), "strategy", "left")
    return out.join(hit_rate(panel, "strategy", "date"), "strategy", "left").join(spread, "strategy", "left").orderBy(F.desc("mean_ic"))


def market_return(panel: DataFrame, column: str = "forward_return") -> DataFrame:
    """Equal-weight mean per date."""
    return panel.groupBy("date").agg(F.avg(column).alias("market"))


def conditional_ic(panel: DataFrame, states: DataFrame, *, lags: int, min_names: int = MIN_NAMES) -> DataFrame:
    """(state, summary) of dates by market state; unlabelled dates are 'none'."""
    ics = rank_ic(panel, min_names=min_names).join(states.select("date", "state"), "date", "left").withColumn("state", F.coalesce("state", F.lit("none")))
    return ic_summary(ics, lags, "state")


def trailing_state(market: DataFrame, window: int) -> DataFrame:
    """(date, trailing, state): the sum of the ``window`` market returns up to a date, and its sign in words."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(1 - window, 0)
    d = market.withColumn("trailing", F.when(F.count("market").over(w) == window, F.sum("market").over(w)))
    return d.select("date", "trailing", F.when(F.col("trailing") > 0, "up").when(F.col("trailing") <= 0, "down").alias("state"))


def evaluation_dates(panel: DataFrame, *, stride: int, most: int | None = None) -> DataFrame:
    """Every ``stride``-th date with a label, the last ``most`` of them."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = panel.where("forward_return is not null").select("date").distinct().withColumn("n", F.row_number().over(w)).where((F.col("n") - 1) % stride == 0).select("date")
    return d.orderBy(F.desc("date")).limit(most) if most else d


def folds(dates: DataFrame, *, folds: int, horizon: int, embargo: int) -> DataFrame:
    """(fold, date, role): walk-forward blocks; training dates end ``horizon + embargo`` dates before the test block."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = dates.select("date").distinct().withColumn("i", F.row_number().over(w) - 1)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    block = d.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(d.sparkSession.range(1, folds + 1).withColumnRenamed("id", "fold")))
    low, high = (F.floor(F.col("n") * k / (folds + 1)) for k in (F.col("fold"), F.col("fold") + 1))
    role = F.when((F.col("i") >= low) & (F.col("i") < high), "test").when(F.col("i") < low - horizon - embargo, "train")
    return block.withColumn("role", role).where("role is not null").select("fold", "date", "role")
