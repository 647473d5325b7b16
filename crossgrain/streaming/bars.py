"""Ticks into bars, the ingest gate and the drawdown breaker as streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crossgrain.operators import quality
from crossgrain.sources.bars import BAR


def tick_bars(ticks: DataFrame, *, unit: str = "1 day", late: str = "2 days") -> DataFrame:
    """Bars of ticks (symbol, ts, price, size, tick_id), for streams and tables alike; later ticks than ``late`` are dropped in a stream.

    The order of ticks within a window is (ts, tick_id).
    """
    at = F.struct("ts", "tick_id")
    d = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    d = d.groupBy("symbol", F.window("ts", unit).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return d.select("symbol", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")


def with_repeats(stream: DataFrame, *, days: int = 400) -> DataFrame:
    """Bars of a stream with ``again``: the symbol and date came before, in whatever batch.

    State is kept for each symbol: its latest date and the dates of the last ``days`` days before it. An older bar cannot be told
    from a repeated one and counts as such.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, seen = state.get if state.exists else (None, [])
        seen = set(seen)
        for rows in batches:
            numbers = [None if pd.isna(d) else pd.Timestamp(d).toordinal() for d in rows["date"]]
            again = []
            for n in numbers:
                again.append(n is not None and (n in seen or (latest is not None and n < latest - days)))
                if n is not None:
                    seen.add(n)
                    latest = n if latest is None else max(latest, n)
            yield rows.assign(again=again)
        state.update((latest, sorted(n for n in seen if n >= latest - days) if latest is not None else []))

    columns = stream.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return stream.groupBy("symbol").applyInPandasWithState(step, columns.replace(",", ", ") + ", again boolean", "latest int, seen array<int>", "append", GroupStateTimeout.NoTimeout)


def gate(stream: DataFrame, accepted: str, quarantine: str, checkpoint: str, *, days: int = 400):
    """Writes every arriving batch of bars to the accepted or the quarantine table, by structural checks; each batch replaces its own folder, so a repeated batch does no harm.

    A date that a symbol already had, in this batch or an earlier one, is a violation, by ``with_repeats``.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read by every check; dropped again below
        repeated = batch.where("again").select("symbol").distinct().select(F.lit("duplicate_date").alias("check"), F.lit(quality.STRUCTURAL).alias("severity"), "symbol")
        found = reduce(DataFrame.unionByName, [*(d.select("check", "severity", "symbol") for d in (quality.price_order(batch), quality.positive_prices(batch))), repeated])
        for rows, path in zip(quality.gated(batch, found), (accepted, quarantine)):
            rows.drop("again").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return with_repeats(stream, days=days).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BREAKER = "book_id string, date date, value double, drawdown double, event string"


def breaker(curves: DataFrame, *, halt: float = 0.15, resume: float = 0.05, cooldown: int = 10, late: str | None = None) -> DataFrame:
    """HALT and RESUME events of equity rows (book_id, date, value), with hysteresis and a cooldown counted in rows.

    A book halts when its drawdown reaches ``halt`` and resumes once it is back within ``resume`` of its peak, or after
    ``cooldown`` rows, when the peak starts anew. State is three numbers for each book.

    Without ``late`` rows count as they arrive, in order of date within a batch. With it (as "30 days") rows may arrive that much
    out of order: they wait in the book's state, a timer of event time wakes it, and what the watermark has passed is counted in
    order of date. Rows later still are dropped, as by any watermark.
    """

    def counted(key: str, rows: list[tuple], peak: float, halted: bool, since: int) -> tuple[list[tuple], float, bool, int]:
        events = []
        for date, value in rows:
            peak = max(peak, value)
            drawdown = 1 - value / peak if peak > 0 else 0.0
            event = None
            if halted:
                since += 1
                if drawdown <= resume or since >= cooldown:
                    if since >= cooldown:
                        peak = value
                    halted, since, event = False, 0, "RESUME"
            elif drawdown >= halt:
                halted, since, event = True, 0, "HALT"
            if event:
                events.append((key, date, value, drawdown, event))
        return events, peak, halted, since

    names = ["book_id", "date", "value", "drawdown", "event"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get if state.exists else (0.0, False, 0)
        rows = [(r.date, r.value) for r in pd.concat(list(batches)).sort_values("date").itertuples(index=False)]
        events, *own = counted(key[0], rows, *own)
        state.update(tuple(own))
        yield pd.DataFrame(events, columns=names)

    def step_in_order(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *own, at, values = state.get if state.exists else (0.0, False, 0, [], [])
        waiting = list(zip(at, values))
        if not state.hasTimedOut:
            waiting += [(int(r.at), float(r.value)) for rows in batches for r in rows.itertuples(index=False)]
        passed = state.getCurrentWatermarkMs()
        due = sorted(w for w in waiting if w[0] <= passed)
        waiting = sorted(w for w in waiting if w[0] > passed)
        events, *own = counted(key[0], [(pd.Timestamp(ms, unit="ms").date(), v) for ms, v in due], *own)
        state.update((*own, [ms for ms, _ in waiting], [v for _, v in waiting]))
        if waiting:
            state.setTimeoutTimestamp(waiting[0][0])
        yield pd.DataFrame(events, columns=names)

    if late is None:
        return curves.groupBy("book_id").applyInPandasWithState(step, BREAKER, "peak double, halted boolean, since int", "append", GroupStateTimeout.NoTimeout)
    ms = F.unix_date("date").cast("long") * 86_400_000
    rows = curves.select("book_id", "value", ms.alias("at"), F.timestamp_millis(ms).alias("_time")).withWatermark("_time", late)
    return rows.groupBy("book_id").applyInPandasWithState(step_in_order, BREAKER, "peak double, halted boolean, since int, at array<bigint>, value array<double>", "append", GroupStateTimeout.EventTimeTimeout)


__all__ = ["BAR", "breaker", "gate", "tick_bars", "with_repeats"]
