"""Streams against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from crossgrain.plans.streams import ticks
from crossgrain.sources.bars import BAR
from crossgrain.streaming.bars import breaker, gate, tick_bars


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_replayed_ticks_make_the_batch_bars(spark, sf, tmp_path):
    events = ticks(spark.read.parquet(f"{sf}/events.parquet"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = tick_bars(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = tick_bars(events).where(F.col("date") < got.agg(F.max("date")).first()[0])
    key = lambda r: (r.symbol, r.date)
    whole = got.where(F.col("date") < got.agg(F.max("date")).first()[0])
    assert whole.count() > 0 and sorted(whole.select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_gate_sets_faulty_symbols_apart(spark, tmp_path):
    rows = [("a", day(0), 10.0, 11.0, 9.0, 10.0, 5.0), ("b", day(0), 10.0, 8.0, 9.0, 10.0, 5.0)]
    spark.createDataFrame(rows, BAR).write.parquet(str(tmp_path / "in"))
    gate(spark.readStream.schema(BAR).parquet(str(tmp_path / "in")), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert [r.symbol for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["a"]
    assert [r.symbol for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["b"]


def test_breaker_halts_and_resumes(spark, tmp_path):
    values = [100, 110, 90, 92, 109, 95, 80, 70, 60]
    spark.createDataFrame([("x", day(i), float(v)) for i, v in enumerate(values)], "book_id string, date date, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("book_id string, date date, value double").parquet(str(tmp_path / "in"))
    q = breaker(stream, halt=0.15, resume=0.05, cooldown=2).writeStream.outputMode("append").format("memory").queryName("events_of_x").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.date, r.event) for r in spark.sql("select * from events_of_x order by date").collect()]
    assert got[0] == (day(2), "HALT") and got[1][1] == "RESUME" and got[-1][1] in ("HALT", "RESUME")


def test_gate_knows_dates_of_earlier_batches(spark, tmp_path):
    bar = lambda s, n: (s, day(n), 10.0, 11.0, 9.0, 10.0, 5.0)
    arrivals = [[bar("a", 0), bar("b", 0)], [bar("a", 1), bar("b", 0), bar("b", 1)], [bar("a", 1), bar("b", 2)], [bar("a", 2), bar("b", 3), bar("b", 3)]]
    for rows in arrivals:
        spark.createDataFrame(rows, BAR).write.mode("append").parquet(str(tmp_path / "in"))
        gate(spark.readStream.schema(BAR).parquet(str(tmp_path / "in")), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    ok, bad = ({(r.symbol, r.date, r.batch) for r in spark.read.schema(f"{BAR}, batch int").parquet(str(tmp_path / p)).collect()} for p in ("ok", "bad"))
    assert ok == {("a", day(0), 0), ("b", day(0), 0), ("a", day(1), 1), ("b", day(2), 2), ("a", day(2), 3)}
    assert bad == {("b", day(0), 1), ("b", day(1), 1), ("a", day(1), 2), ("b", day(3), 3)}


def test_breaker_puts_late_rows_in_order(spark, tmp_path):
    values = [100, 110, 90, 92, 109, 95, 80, 70, 60, 120, 119]
    schema = "book_id string, date date, value double"
    order, events = [[0, 2, 3], [1, 5, 4], [8, 7, 6], [10, 9]], {}
    for how, batches in (("sorted", [list(range(len(values)))]), ("late", order)):
        src, out, cp = (str(tmp_path / f"{how}-{x}") for x in ("in", "out", "cp"))
        for at in [*batches, None]:
            rows = [("x", day(i), float(values[i])) for i in at] if at is not None else [("", day(900), 1.0)]
            spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
            q = breaker(spark.readStream.schema(schema).parquet(src), halt=0.15, resume=0.05, cooldown=2, late="6 days").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            q.awaitTermination()
        events[how] = sorted((r.date, r.event, r.drawdown) for r in spark.read.parquet(out).collect())
    assert events["late"] == events["sorted"] and [e[1] for e in events["sorted"]][:2] == ["HALT", "RESUME"] and len(events["sorted"]) > 3
