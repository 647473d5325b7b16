"""Streams replayed from the given tables (S1), and isotonic rates by MLlib (M5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding
from crossgrain.plans.common import scored
from crossgrain.plans.registry import query
from crossgrain.sources.bars import table
from crossgrain.streaming.bars import tick_bars

TICKS = """SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(date_trunc('day', ts) AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2"""


def ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1).cast("long").alias("size"), F.col("event_id").alias("tick_id"))


@query("S1_tick_bars", TICKS)
def s1(spark, sf):
    """The batch form; a test replays the same ticks as a stream."""
    return tick_bars(ticks(table(spark, sf, "events")))


@query("M5_isotonic_calibration")
def m5(spark, sf):
    """Win rate by score, pooled where it falls; fitted by MLlib and read back at every score."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    d = scored(spark, sf).withColumn("won", (F.col("forward_return") > 0).cast("double"))
    rows = VectorAssembler(inputCols=["score"], outputCol="x").transform(d)
    fitted = IsotonicRegression(featuresCol="x", labelCol="won", predictionCol="p").fit(rows).transform(rows)
    return fitted.select("date", "symbol", rounding("p", 6).alias("p"))
