"""Window helpers: full frames, average ranks, folds, grids and as-of look-ups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def own(*, key: str = "symbol", order: str = "date") -> WindowSpec:
    """A symbol's rows in time."""
    return Window.partitionBy(key).orderBy(order)


def across(*keys: str) -> WindowSpec:
    """All rows of a date."""
    return Window.partitionBy(*(keys or ("date",)))


def full(fn: Callable[[Column], Column], x: Column | str, rows: int, *, least: int | None = None, lag: int = 1, key: str = "symbol", order: str = "date") -> Column:
    """``fn`` over the ``rows`` rows that end ``lag`` rows ago; null unless ``least`` of them (all, if not said) have a value."""
    x = F.col(x) if isinstance(x, str) else x
    frame = own(key=key, order=order).rowsBetween(-rows - lag + 1, -lag)
    return F.when(F.count(x).over(frame) >= (least or rows), fn(x).over(frame))


def change(x: Column | str, periods: int, *, lag: int = 0, key: str = "symbol") -> Column:
    """Relative change over ``periods`` rows as it stood ``lag`` rows ago; no gap is filled."""
    x = F.col(x) if isinstance(x, str) else x
    w = own(key=key)
    now = F.lag(x, lag).over(w) if lag else x
    return F.try_divide(now, F.lag(x, lag + periods).over(w)) - 1


def average_rank(x: Column | str, *keys: str) -> Column:
    """Rank within a date, ties averaged."""
    x = F.col(x) if isinstance(x, str) else x
    keys = keys or ("date",)
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def percentile_rank(x: Column | str, *keys: str) -> Column:
    """Average rank over n + 1."""
    return average_rank(x, *keys) / (F.count(F.lit(1)).over(across(*keys)) + 1)


def bucket(x: Column | str, buckets: int, *keys: str) -> Column:
    """0 for the lowest to ``buckets`` - 1, by percentile; not of equal sizes, as ntile would have them."""
    at = F.floor(percentile_rank(x, *keys) * buckets)
    return F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)).cast("long")


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def folded(df: DataFrame, start: Column, step: Callable[[Column, Column], Column], item: Column, *, out: str = "state", key: str = "symbol", order: str = "date", chunk: int = 64) -> DataFrame:
    """Adds ``out``: the state after each row of a fold over a key's rows in order (rows that share a place in order follow by their other columns).

    One sorted array per key, folded inside the JVM; for recursions that no frame can express. The rows go through the fold
    themselves, so none is matched to another. States are gathered ``chunk`` at a time, so that adding one copies no history.
    """
    item = item.alias("_item")
    others = [c for c in df.columns if c not in (key, order)]
    rows = df.select(key, order, item, F.struct(*others).alias("_rest")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "_item", "_rest"))).alias("_rows"))
    kind = _kind(df, start)
    many = F.struct(start.alias("now"), F.array().cast(f"array<array<{kind}>>").alias("all"))

    def one(acc: Column, x: Column) -> Column:
        now = step(acc["now"], x["_item"])
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

    def part(acc: Column, xs: Column) -> Column:
        begun = F.struct(acc["now"].alias("now"), F.array().cast(f"array<{kind}>").alias("all"))
        return F.aggregate(xs, begun, one, lambda got: F.struct(got["now"].alias("now"), F.concat(acc["all"], F.array(got["all"])).alias("all")))

    parts = F.transform(F.sequence(F.lit(1), F.size("_rows"), F.lit(chunk)), lambda at: F.slice("_rows", at, F.lit(chunk)))
    states = F.flatten(F.aggregate(parts, many, part)["all"])
    done = rows.select(key, F.explode(F.arrays_zip(F.col("_rows"), states.alias(out))).alias("_z"))
    return done.select(key, f"_z._rows.{order}", *[F.col(f"_z._rows._rest.{c}").alias(c) for c in others], f"_z.{out}").select(*df.columns, out)


def _kind(df: DataFrame, x: Column) -> str:
    return df.limit(0).select(x.alias("x")).schema["x"].dataType.simpleString()


def dense(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every symbol on every date that any symbol has, gaps null."""
    dates, symbols = bars.select("date").distinct(), bars.select("symbol").distinct()
    return dates.crossJoin(symbols).join(bars.select("symbol", "date", *columns), ["symbol", "date"], "left")


def as_of(grid: DataFrame, facts: DataFrame, columns: Sequence[str], *, at: str, key: str = "symbol", order: str = "date") -> DataFrame:
    """``grid`` with the latest non-null value of every fact column known on or before its date.

    Facts and grid are interleaved in one sorted pass per key, facts first on a tie; no range join.
    """
    f = facts.select(key, F.col(at).alias(order), *columns, F.lit(0).alias("_side"))
    g = grid.withColumn("_side", F.lit(1))
    both = g.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).where("_side = 1").drop("_side")


def rounding(x: Column | str, digits: int) -> Column:
    """Rounded half up in binary arithmetic, which every engine does alike."""
    x = F.col(x) if isinstance(x, str) else x
    scale = 10.0**digits
    return F.floor(x * scale + 0.5).cast("double") / scale


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for output."""
    return df.select(*[rounding(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
