"""Price bars: one row per symbol and date, from trades or from files of bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"

#: Column names that mean the same, after lower-casing and folding spaces and dashes; fixed values.
ALIASES = {
    "date": ("date", "datetime", "timestamp", "day"),
    "open": ("open", "open_price"),
    "high": ("high", "high_price"),
    "low": ("low", "low_price"),
    "close": ("close", "close_price", "last"),
    "adj_close": ("adj_close", "adjusted_close", "adjclose"),
    "volume": ("volume", "vol", "quantity"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from_trades(trades: DataFrame, *, symbol: str, time: str, price: Column, size: str, order: Sequence[str], unit: str) -> DataFrame:
    """Open, high, low, close and volume per symbol and calendar unit; ``order`` breaks ties in time.

    One partial aggregation and one shuffle on (symbol, date).
    """
    key = F.struct(*order)
    rows = trades.select(F.col(symbol).cast("string").alias("symbol"), F.to_date(F.date_trunc(unit, F.col(time))).alias("date"), price.alias("px"), F.col(size).cast("double").alias("size"), key.alias("at"))
    return rows.groupBy("symbol", "date").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.sum("size").alias("volume")
    )


def bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Bars of the trade table: a symbol per supplier, unit prices, shipped quantities."""
    return bars_from_trades(
        table(spark, sf_dir, "lineitem"),
        symbol="l_suppkey",
        time="l_shipdate",
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        size="l_quantity",
        order=("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"),
        unit=unit,
    )


def bars_sql(unit: str = "week", name: str = "b") -> str:
    """The same bars as a common table expression for the oracle."""
    order = "l_shipdate, l_orderkey, l_linenumber, l_partkey"
    return f"""{name} AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date,
        first(px ORDER BY {order}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {order}) AS close, sum(CAST(l_quantity AS DOUBLE)) AS volume
        FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY 1, 2)"""


def scan(bars: DataFrame, *, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a universe within inclusive dates; both filters reach the files."""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(*symbols))
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    return bars


def symbols_of(bars: DataFrame) -> DataFrame:
    """Distinct symbols without index symbols (``^``)."""
    return bars.select("symbol").distinct().where(~F.col("symbol").startswith("^"))


def canonical(ticker: Column, suffix: str = ".NS") -> Column:
    """Upper case with the exchange suffix; index symbols and suffixed ones keep their form."""
    up = F.upper(F.trim(ticker))
    return F.when(up.startswith("^") | up.endswith(suffix), up).otherwise(F.concat(up, F.lit(suffix)))


def plain_symbol(ticker: Column, suffix: str = ".NS") -> Column:
    """The inverse of ``canonical``."""
    up = F.upper(F.trim(ticker))
    return F.when(up.endswith(suffix), F.substring(up, F.lit(1), F.length(up) - len(suffix))).otherwise(up)


def normalized(raw: DataFrame, *, symbol: Column, sequence: str, adjust: bool = True) -> DataFrame:
    """Raw rows of any spelling as bars: typed, adjusted by the close's factor, one row per symbol and date (the last one).

    Missing legs take the close, a missing volume 0; raw legs are kept.
    """
    folded = {c.strip().lower().replace(" ", "_").replace("-", "_"): c for c in raw.columns}

    def col(name: str) -> Column:
        found = next((folded[a] for a in ALIASES[name] if a in folded), None)
        return F.col(f"`{found}`") if found else F.lit(None)

    def num(name: str) -> Column:
        value = col(name).try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    close = F.coalesce(num("close"), num("adj_close"))
    ratio = F.try_divide(num("adj_close"), close)
    factor = F.coalesce(F.when(F.abs(ratio) < float("inf"), ratio), F.lit(1.0)) if adjust else F.lit(1.0)
    rows = raw.select(symbol.alias("symbol"), col("date").try_cast("date").alias("date"), close.alias("close_raw"), factor.alias("adj_factor"), *[F.coalesce(num(c), close).alias(f"{c}_raw") for c in ("open", "high", "low")], F.coalesce(num("volume"), F.lit(0.0)).alias("volume"), F.col(sequence).alias("seq"))
    rows = rows.where("date is not null and close_raw is not null")
    last = Window.partitionBy("symbol", "date").orderBy(F.col("seq").desc())
    rows = rows.withColumn("n", F.row_number().over(last)).where("n = 1")
    legs = [(F.col(f"{c}_raw") * F.col("adj_factor")).alias(c) for c in ("open", "high", "low", "close")]
    return rows.select("symbol", "date", *legs, "volume", "open_raw", "high_raw", "low_raw", "close_raw", "adj_factor")


def corporate_actions(bars: DataFrame, *, tolerance: float = 0.005) -> DataFrame:
    """(symbol, date, kind, value, stated): stated splits and dividends, and jumps of the adjustment factor without one."""
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars.withColumn("jump", F.try_divide(F.col("adj_factor"), F.lag("adj_factor").over(w)))
    moved = F.coalesce(F.abs(F.col("jump") - 1) > tolerance, F.lit(False))
    one = lambda kind, value, stated: F.struct(F.lit(kind).alias("kind"), value.alias("value"), stated.alias("stated"))
    split = F.coalesce(F.col("stock_splits"), F.lit(0.0)) != 0
    paid = F.coalesce(F.col("dividends"), F.lit(0.0)) != 0
    found = F.array_compact(F.array(F.when(split, one("split", F.col("stock_splits"), F.lit(True))), F.when(paid, one("dividend", F.col("dividends"), F.lit(True))), F.when(moved & ~split & ~paid, one("implied", F.col("jump"), F.lit(False)))))
    return b.select("symbol", "date", F.explode(found).alias("a"), moved.alias("factor_moved")).select("symbol", "date", "a.kind", "a.value", "a.stated", "factor_moved")


def write_bars(bars: DataFrame, path: str, *, files: int | None = None) -> None:
    """Bars ordered by symbol and date within files of whole symbols; rows without any number are dropped."""
    numbers = [c for c in ("open", "high", "low", "close", "volume") if c in bars.columns]
    kept = bars.dropna(how="all", subset=numbers)
    kept = kept.repartition(files, "symbol") if files else kept.repartition("symbol")
    kept.sortWithinPartitions("symbol", "date").write.mode("overwrite").parquet(path)


def store_bars(bars: DataFrame, name: str, *, buckets: int, path: str | None = None) -> DataFrame:
    """Bars as a table bucketed by symbol and sorted by date, read again: windows and joins by symbol need no shuffle.

    A row without any number is dropped; a symbol and date has one row, the caller's to see to. The table replaces one of its name;
    with ``path`` its files lie there, else in the warehouse.
    """
    numbers = [c for c in ("open", "high", "low", "close", "volume") if c in bars.columns]
    rows = bars.dropna(how="all", subset=numbers).repartition(buckets, "symbol")  # one file a bucket
    writer = rows.write.format("parquet").mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "date")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return bars.sparkSession.table(name)
