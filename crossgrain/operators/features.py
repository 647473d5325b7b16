"""Lagged features of a symbol's own rows.

Every window ends at the row before, so a value at a date uses earlier rows
alone; ``close`` is the row's own, and momentum starts where its skip ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.frames import change, dense, folded, full, own

#: Price limits and how close a move must come to one; fixed values.
BANDS = (0.01, 0.02, 0.05, 0.10, 0.20)
BAND_TOLERANCE = 0.004
BAND_SHARE = 0.25
SESSIONS = 252

FEATURES: dict[str, Callable[[], Column]] = {}
WARMUP: dict[str, int] = {}


def feature(name: str, warmup: int) -> Callable:
    """Registers a builder of a Column under a name, with the rows it needs before its first value."""

    def add(build: Callable[[], Column]) -> Callable[[], Column]:
        FEATURES[name], WARMUP[name] = build, warmup
        return build

    return add


def with_features(bars: DataFrame, names: list[str]) -> DataFrame:
    """``bars`` with the named features; all share one sort per symbol."""
    unknown = sorted(set(names) - set(FEATURES))
    if unknown:
        raise KeyError(f"unknown features: {unknown}")
    return bars.withColumns({n: FEATURES[n]() for n in names})


def warmup_rows(names: list[str]) -> int:
    """Rows before any of the features has a value."""
    return max((WARMUP[n] for n in names), default=0)


def moving_average(n: int) -> Column:
    return full(F.avg, "close", n)


def upper_channel(n: int) -> Column:
    return full(F.max, "high", n)


def _true_range() -> Column:
    before = F.lag("close").over(own())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


for _n, _name in ((20, "sma_20"), (50, "sma_50"), (200, "sma_200")):
    feature(_name, _n)(lambda n=_n: moving_average(n))
feature("donchian_upper_20", 20)(lambda: upper_channel(20))
feature("close", 0)(lambda: F.col("close"))
feature("return_1d", 2)(lambda: change("close", 1, lag=1))
feature("return_5d", 6)(lambda: change("close", 5, lag=1))
feature("return_21d", 22)(lambda: change("close", 21, lag=1))
feature("volume_ratio_20", 20)(lambda: F.try_divide(full(F.avg, "volume", 5), full(F.avg, "volume", 20)))
feature("mom_9m_skip1m", 210)(lambda: change("close", 189, lag=21))


def momentum(formation: int, skip: int) -> Column:
    return change("close", formation, lag=skip)


def true_range(bars: DataFrame) -> DataFrame:
    """Adds ``tr``; the first row has no previous close and takes its own range."""
    return bars.withColumn("tr", _true_range())


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return true_range(bars).withColumn(f"atr_{n}", full(F.avg, "tr", n)).drop("tr")


def with_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength with simple means; a missing change counts as no change."""
    w = own()
    d = bars.withColumn("_d", F.coalesce(F.lag("close", 1).over(w) - F.lag("close", 2).over(w), F.lit(0.0)))
    d = d.withColumns({"_up": F.greatest("_d", F.lit(0.0)), "_down": F.greatest(-F.col("_d"), F.lit(0.0))})
    up, down = (full(F.avg, c, n, lag=0) for c in ("_up", "_down"))
    out = F.when(down == 0, F.when(up > 0, F.lit(100.0))).otherwise(100 - 100 / (1 + up / F.when(down != 0, down)))
    return d.withColumn(f"rsi_{n}", out).drop("_d", "_up", "_down")


def with_percent_b(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mid, sd = full(F.avg, "close", n), full(F.stddev_samp, "close", n)
    last = F.lag("close").over(own())
    return bars.withColumn("bollinger_pct_b", F.try_divide(last - (mid - width * sd), 2 * width * sd))


def with_volatility(bars: DataFrame, n: int, per_year: int = SESSIONS) -> DataFrame:
    """Annualized standard deviation of returns."""
    d = bars.withColumn("_r", change("close", 1))
    return d.withColumn(f"realized_vol_{n}", full(F.stddev_samp, "_r", n) * F.sqrt(F.lit(float(per_year)))).drop("_r")


def with_traded_value(bars: DataFrame, n: int = 60, least: int = 20) -> DataFrame:
    """``traded_value_<n>``: the median of close times volume over the ``n`` rows before, of which ``least`` have one."""
    d = bars.withColumn("_v", F.col("close") * F.col("volume"))
    d = d.withColumn("_vs", F.sort_array(F.collect_list("_v").over(own().rowsBetween(-n, -1))))
    size = F.size("_vs")
    middle = (F.get("_vs", F.floor((size - 1) / 2).cast("int")) + F.get("_vs", F.floor(size / 2).cast("int"))) / 2
    return d.withColumn(f"traded_value_{n}", F.when(size >= least, middle)).drop("_v", "_vs")


def at_band(move: Column) -> Column:
    """Whether an absolute move is at a price limit, or beyond the widest."""
    near = [F.abs(move - b) <= min(BAND_TOLERANCE, b * BAND_SHARE) for b in BANDS]
    out = move >= max(BANDS) - min(BAND_TOLERANCE, max(BANDS) * BAND_SHARE)
    for c in near:
        out = out | c
    return out


def with_limit_flags(bars: DataFrame) -> DataFrame:
    """locked, trapped, locked_down and zero_return of each row's own session; false where unknown."""
    move = change("close", 1)
    d = bars.withColumns({"_m": move, "_c": F.col("close") - F.lag("close").over(own())})
    limit = at_band(F.abs("_m"))
    equal = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9
    flags = {
        "locked": equal("high", "low") & limit,
        "trapped": equal("high", "close") & (F.col("_m") > 0) & limit,
        "locked_down": equal("low", "close") & (F.col("_m") < 0) & limit,
        "zero_return": F.abs("_c") <= 1e-12,
    }
    return d.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("_m", "_c")


def with_limit_shares(flagged: DataFrame, n: int = 60, least: int = 20) -> DataFrame:
    """The flags of the row before, and their shares of the last ``n`` rows."""
    out = {}
    for c in ("locked", "trapped", "locked_down", "zero_return"):
        x = F.col(c).cast("double")
        out[f"{c}_last"] = F.lag(c).over(own())
        out[f"{c}_share"] = full(F.avg, x, n, least=least)
    return flagged.withColumns(out)


def with_ema(df: DataFrame, column: str, span: float, *, out: str, alpha: float | None = None) -> DataFrame:
    """Exponential average from the first value on: recursive, so a fold; null values leave it as it is."""
    a = alpha if alpha is not None else 2.0 / (span + 1)

    def step(now: Column, x: Column) -> Column:
        return F.when(x.isNull(), now).when(now.isNull(), x).otherwise(a * x + (1 - a) * now)

    return folded(df, F.lit(None).cast("double"), step, F.col(column), out=out)


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    """Difference of two exponential averages of the lagged close."""
    d = bars.withColumn("_last", F.lag("close").over(own()))
    d = with_ema(with_ema(d, "_last", fast, out="_fast"), "_last", slow, out="_slow")
    return d.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_last", "_fast", "_slow")


def with_adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement index by Wilder averages, each null until it has ``n`` values; ``adx`` is the row's own, ``adx_lag`` the one before."""
    w = own()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    d = true_range(bars).withColumns({"_up": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)), "_down": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)), "_i": F.row_number().over(w)})
    for c in ("tr", "_up", "_down"):
        d = with_ema(d, c, 0, alpha=1.0 / n, out=f"{c}_e")
    ready = F.col("_i") >= n
    tr = F.when(ready & (F.col("tr_e") != 0), F.col("tr_e"))
    plus, minus = (100 * F.when(ready, F.col(f"{c}_e")) / tr for c in ("_up", "_down"))
    d = d.withColumns({"_plus": plus, "_minus": minus})
    d = d.withColumn("_dx", 100 * F.abs(F.col("_plus") - F.col("_minus")) / F.when(F.col("_plus") + F.col("_minus") != 0, F.col("_plus") + F.col("_minus")))
    d = with_ema(d, "_dx", 0, alpha=1.0 / n, out="_adx")
    seen = F.count("_dx").over(w.rowsBetween(-(1 << 30), 0))
    d = d.withColumn("adx", F.when(seen >= n, F.col("_adx")))
    return d.withColumn("adx_lag", F.lag("adx").over(w)).drop("tr", "tr_e", "_up", "_down", "_up_e", "_down_e", "_i", "_plus", "_minus", "_dx", "_adx")


def past_zscore(df: DataFrame, column: str, n: int = SESSIONS, epsilon: float = 1e-8) -> DataFrame:
    """A value against the mean and deviation of earlier rows alone."""
    frame = own().rowsBetween(-n, -1)
    sd = F.stddev_samp(column).over(frame)
    return df.withColumn(f"{column}_z", (F.col(column) - F.avg(column).over(frame)) / (sd + epsilon))


def forward_return(periods: int) -> Column:
    """The label: return over the following rows."""
    return F.try_divide(F.lead("close", periods).over(own()), F.col("close")) - 1


def intraday_and_overnight(bars: DataFrame) -> DataFrame:
    """Close over open, and open over the close before; complete rows only."""
    d = bars.withColumns({"intraday": F.try_divide(F.col("close"), F.col("open")) - 1, "overnight": F.try_divide(F.col("open"), F.lag("close").over(own())) - 1})
    return d.where("intraday is not null and overnight is not null")


def cross_sectional(bars: DataFrame, inputs: Sequence[str], made: dict[str, Callable[[dict[str, Column]], Column]], *, lag: int = 1) -> DataFrame:
    """(symbol, date, features): each of ``made`` sees its inputs only as they stood ``lag`` rows before, on the dense grid of symbols and dates."""
    if lag < 1:
        raise ValueError("inputs have to be at least a row old")
    seen = dense(bars, inputs).select("symbol", "date", *[F.lag(c, lag).over(own()).alias(c) for c in inputs])
    known = {c: F.col(c) for c in inputs}
    return seen.select("symbol", "date", *[make(known).alias(name) for name, make in made.items()])
