"""Features by name: single-name and cross-sectional ones, compiled to one stage of windows by symbol and one by date.

A cross-sectional feature declares the columns it reads and how old they have to
be; it is handed columns of that age and has no way to the rows' own values. A
name is registered once, for one kind. What is asked for together shares the sort
by symbol and the shuffle by date, whatever its number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.frames import across, own
from crossgrain.operators import features as ft

Columns = dict[str, Column]


@dataclass(frozen=True)
class CrossFeature:
    """``along`` makes helper columns over the symbol's rows, ``build`` the feature over the date's; both see inputs ``lag`` rows old."""

    inputs: tuple[str, ...]
    lag: int
    warmup: int
    along: Callable[[Columns], Columns] | None
    build: Callable[[Columns], Column]


CROSS: dict[str, CrossFeature] = {}
#: Features that need a helper column: name -> (bars to bars, rows before the first value).
FRAMES: dict[str, tuple[Callable[[DataFrame], DataFrame], int]] = {
    "atr_14": (ft.with_atr, 15), "rsi_14": (ft.with_rsi, 16), "bollinger_pct_b": (ft.with_percent_b, 20), "macd": (ft.with_macd, 1),
    "realized_vol_60": (lambda d: ft.with_volatility(d, 60), 61), "traded_value_60": (ft.with_traded_value, 20),
}
#: Named sets; fixed values.
SETS: dict[str, tuple[str, ...]] = {
    "default": ("sma_20", "sma_50", "rsi_14", "macd", "bollinger_pct_b", "atr_14", "return_1d", "return_5d"),
    "cross_sectional": ("mom_9m_skip1m", "realized_vol_60", "sma_50", "sma_200", "atr_14", "return_5d", "traded_value_60"),
    "relative": ("relative_price", "excess_return_1", "reversal_rank", "value_share"),
}


def cross_feature(name: str, inputs: Sequence[str], *, lag: int = 1, warmup: int = 0, along: Callable[[Columns], Columns] | None = None) -> Callable:
    """Registers ``build`` under a name that no other feature has; inputs are at least one column, and ``lag`` is 0 only for what is known at the decision."""
    if not inputs:
        raise ValueError(f"{name} reads nothing")
    if lag < 0:
        raise ValueError(f"{name} would read later rows")
    if name in CROSS or name in FRAMES or name in ft.FEATURES:
        raise ValueError(f"{name} is registered already")

    def add(build: Callable[[Columns], Column]) -> Callable[[Columns], Column]:
        CROSS[name] = CrossFeature(tuple(inputs), lag, warmup + lag, along, build)
        return build

    return add


def _change(x: Column, rows: int) -> Column:
    return F.try_divide(x, F.lag(x, rows).over(own())) - 1


@cross_feature("relative_price", ["close"])
def _relative_price(c: Columns) -> Column:
    return F.try_divide(c["close"], F.avg(c["close"]).over(across("date")))


@cross_feature("excess_return_1", ["close"], warmup=1, along=lambda c: {"r": _change(c["close"], 1)})
def _excess_return(c: Columns) -> Column:
    return c["r"] - F.avg(c["r"]).over(across("date"))


@cross_feature("reversal_rank", ["close"], warmup=4, along=lambda c: {"r": _change(c["close"], 4)})
def _reversal_rank(c: Columns) -> Column:
    """The fallen come last in a falling order, so theirs is the highest share."""
    falling = F.rank().over(across("date").orderBy(F.desc_nulls_last(c["r"])))
    ties = (F.count(F.lit(1)).over(across("date", c["r"])) - 1) / 2
    return F.when(c["r"].isNotNull(), (falling + ties) / (F.count(c["r"]).over(across("date")) + 1))


@cross_feature("value_share", ["close", "volume"])
def _value_share(c: Columns) -> Column:
    value = c["close"] * c["volume"]
    return F.try_divide(value, F.sum(value).over(across("date")))


def resolved(asked: str | Sequence[str]) -> list[str]:
    """The names of a set, of ``all``, or those given, each once and in order; an unknown one is an error that lists what there is."""
    every = sorted({*ft.FEATURES, *FRAMES, *CROSS})
    if isinstance(asked, str):
        if asked != "all" and asked not in SETS:
            raise ValueError(f"unknown feature set {asked!r}; there are {sorted([*SETS, 'all'])}")
        asked = every if asked == "all" else SETS[asked]
    names = list(dict.fromkeys(asked))
    if unknown := sorted(set(names) - set(every)):
        raise ValueError(f"unknown features {unknown}; there are {every}")
    return names


def warmup_rows(asked: str | Sequence[str]) -> int:
    """Rows of a symbol before all of the features have a value."""
    rows = {**ft.WARMUP, **{n: w for n, (_, w) in FRAMES.items()}, **{n: f.warmup for n, f in CROSS.items()}}
    return max((rows[n] for n in resolved(asked)), default=0)


def planned(bars: DataFrame, asked: str | Sequence[str], *, start: str | None = None, end: str | None = None, days_a_row: float = 1.6) -> DataFrame:
    """(symbol, date, features) within ``start`` and ``end``, inclusive.

    Bars are read from as many rows before ``start`` as the features' warm-ups, counted as ``days_a_row`` days each. A column that
    a cross-sectional feature declares and ``bars`` lacks is an error before anything runs.
    """
    names = resolved(asked)
    crossing = [n for n in names if n in CROSS]
    if lacking := sorted({c for n in crossing for c in CROSS[n].inputs} - set(bars.columns)):
        raise ValueError(f"bars have no {lacking}")
    if end:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    if start:
        bars = bars.where(F.col("date") >= F.date_sub(F.lit(start).cast("date"), math.ceil(warmup_rows(names) * days_a_row)))
    d = bars.withColumns({n: ft.FEATURES[n]() for n in names if n in ft.FEATURES and n not in bars.columns})
    for n in names:
        if n in FRAMES:
            d = FRAMES[n][0](d)
    aged = sorted({(c, CROSS[n].lag) for n in crossing for c in CROSS[n].inputs})
    d = d.withColumns({f"_{c}_{k}": F.lag(c, k).over(own()) if k else F.col(c) for c, k in aged}) if aged else d
    known = {n: {c: F.col(f"_{c}_{CROSS[n].lag}") for c in CROSS[n].inputs} for n in crossing}
    helpers = {f"_{n}_{h}": x for n in crossing if CROSS[n].along for h, x in CROSS[n].along(known[n]).items()}
    d = d.withColumns(helpers) if helpers else d
    for n in crossing:
        known[n] |= {h: F.col(f"_{n}_{h}") for h in (CROSS[n].along(known[n]) if CROSS[n].along else {})}
    if start:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    if crossing:
        d = d.select("symbol", "date", *[n for n in names if n not in CROSS], *[f"_{c}_{k}" for c, k in aged], *helpers)
        d = d.withColumns({n: CROSS[n].build(known[n]) for n in crossing})
    return d.select("symbol", "date", *names)
