"""Panels that several queries share, and the same panels in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.functions.frames import rounded
from crossgrain.operators import features, metrics
from crossgrain.sources.bars import bars, bars_sql

FORMATION, SKIP = 26, 4
BUCKETS = 5


def out(df: DataFrame) -> DataFrame:
    return rounded(df)


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def valid(panel: DataFrame) -> DataFrame:
    """Rows with a score and a label that is not absurd."""
    return metrics.without_absurd_labels(metrics.validated(panel))


def scored(spark: SparkSession, sf_dir: str, *, unit: str = "week", horizons: tuple[int, ...] = ()) -> DataFrame:
    """date, symbol, close, score (momentum), forward_return and those of other horizons; absurd labels dropped."""
    b = bars(spark, sf_dir, unit)
    labels = {f"forward_return_{h}": features.forward_return(h) for h in horizons}
    b = b.withColumns({"score": features.momentum(FORMATION, SKIP), "forward_return": features.forward_return(1), **labels})
    return valid(b).select("date", "symbol", "close", "volume", "score", "forward_return", *labels)


def scored_sql(unit: str = "week", horizons: tuple[int, ...] = ()) -> str:
    extra = "".join(f", lead(close, {h}) OVER w / close - 1 AS forward_return_{h}" for h in horizons)
    names = "".join(f", forward_return_{h}" for h in horizons)
    return f"""{bars_sql(unit)},
    p AS (SELECT date, symbol, close, volume, score, forward_return{names} FROM (
        SELECT *, lag(close, {SKIP}) OVER w / lag(close, {SKIP + FORMATION}) OVER w - 1 AS score, lead(close, 1) OVER w / close - 1 AS forward_return{extra}
        FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE score IS NOT NULL AND forward_return IS NOT NULL AND abs(forward_return) <= 5)"""


def average_rank_sql(x: str, keys: str = "date") -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"


def ic_sql(keys: str = "date", source: str = "p", score: str = "score", label: str = "forward_return") -> str:
    return f"""ic AS (SELECT {keys}, corr(a, r) AS ic, count(*) AS names FROM (SELECT {keys}, {average_rank_sql(score, keys)} AS a, {average_rank_sql(label, keys)} AS r FROM {source})
        GROUP BY ALL HAVING count(*) >= 5 AND min(a) < max(a) AND min(r) < max(r))"""


def bucketed_sql(keys: str = "date", source: str = "p", buckets: int = BUCKETS) -> str:
    return f"""q AS (SELECT *, CAST(least(greatest(floor({average_rank_sql('score', keys)} / (count(*) OVER (PARTITION BY {keys}) + 1) * {buckets}), 0), {buckets - 1}) AS BIGINT) AS bucket
        FROM {source} QUALIFY count(*) OVER (PARTITION BY {keys}) >= 5)"""


def registered(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("strategy", F.lit(name))
