"""Caps, expected returns, sleeves, exponential covariance, breakers and learned weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.frames import across, folded


def capped(weights: DataFrame, cap: float) -> DataFrame:
    """Weights of a date cut at ``cap``, what is cut going to the others in proportion; equal where the cap cannot be met.

    Those cut are the largest: as many as it takes for the next to stay within the cap once it has its part. That is where cutting again
    and again ends.
    """
    w, up = across("date"), Window.partitionBy("date").orderBy("weight", F.desc("symbol"))  # a frame to the end would be summed anew for each row
    n = F.count(F.lit(1)).over(w)
    d = weights.withColumns({"_n": n, "_k": n - F.row_number().over(up), "_rest": F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, 0))})
    scale = F.try_divide(1 - F.col("_k") * cap, F.col("_rest"))
    d = d.withColumn("_fit", F.when(F.col("weight") * scale <= cap * (1 + 1e-12), F.struct(F.col("_k"), scale.alias("scale"))))
    d = d.withColumn("_at", F.min("_fit").over(w))
    cut = F.when(F.col("_k") < F.col("_at._k"), F.lit(cap)).otherwise(F.col("weight") * F.col("_at.scale"))
    return d.select("date", "symbol", F.when(F.col("_n") * cap <= 1, 1.0 / F.col("_n")).otherwise(cut).alias("weight"))


def expected_returns(panel: DataFrame, spread: float) -> Column:
    """A score's place between its date's least and largest, centred, times ``spread``."""
    w = across("date")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return (F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(0.5)) - 0.5) * spread


def sleeve_weights(states: DataFrame, affinity: DataFrame) -> DataFrame:
    """(date, sleeve, weight): state probabilities times each sleeve's affinity, normalized; the affinity table is states by sleeves."""
    d = states.join(F.broadcast(affinity), "state").groupBy("date", "sleeve").agg(F.sum(F.col("probability") * F.col("affinity")).alias("w"))
    return d.select("date", "sleeve", F.try_divide(F.col("w"), F.sum("w").over(across("date"))).alias("weight"))


def breaker(curves: DataFrame, *, halt: float, resume: float, cooldown: int = 10) -> DataFrame:
    """(book_id, date, halted, event): a book halts at a drawdown of ``halt``, and resumes within ``resume`` of its peak or after ``cooldown`` rows, when the peak starts anew."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0).alias("since"), F.lit(False).alias("halted"), F.lit("").alias("event"))

    def step(s: Column, value: Column) -> Column:
        peak, since = F.greatest(s["peak"], value), s["since"] + 1
        drawdown = F.when(peak > 0, 1 - value / peak).otherwise(0.0)
        over = s["halted"] & (since >= cooldown)
        halted = F.when(s["halted"], (drawdown > resume) & ~over).otherwise(drawdown >= halt)
        event = F.when(halted & ~s["halted"], "HALT").when(~halted & s["halted"], "RESUME").otherwise("")
        return F.struct(F.when(over, value).otherwise(peak).alias("peak"), F.when(halted & s["halted"], since).otherwise(0).alias("since"), halted.alias("halted"), event.alias("event"))

    d = folded(curves, start, step, F.col("value"), key="book_id")
    return d.select("book_id", "date", F.col("state.halted").alias("halted"), F.col("state.event").alias("event"))


def binomial_tail(wins: Column, total: Column) -> Column:
    """The chance of ``wins`` or more of ``total`` at even odds, for ``wins`` of at least half.

    Each term follows from the one before, and from the middle on terms only fall: the sum is taken relative to its first term, whose
    logarithm is the only one worked out.
    """
    first = F.aggregate(F.sequence(F.lit(1), F.greatest(total - wins, F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(i <= total - wins, F.log((wins + i) / i)).otherwise(0.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, k: F.struct((s["term"] * (total - k) / (k + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    return F.least(F.lit(1.0), F.exp(first - total * F.log(F.lit(2.0))) * F.aggregate(F.sequence(wins, total), start, step, lambda s: s["sum"]))


def learned_weights(trades: DataFrame, base: dict[str, float], *, strength: float = 20.0, least: float = 5.0) -> DataFrame:
    """(trigger, wins, total, rate, p_value, weight): base weights scaled by shrunk win rates, floored and brought to 100, one decimal, the rounding's rest on the largest; triggers are a handful.

    ``p_value`` is the exact binomial tail on the side of the wins.
    """
    w = Window.partitionBy(F.lit(0))
    known = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    d = trades.groupBy("trigger").agg(F.count_if("won").alias("wins"), F.count(F.lit(1)).alias("total"))
    rate = (F.col("wins") + strength * 0.5) / (F.col("total") + strength)
    d = d.withColumns({"rate": rate, "raw": F.greatest(F.try_element_at(known, F.col("trigger")) * rate * 2, F.lit(least))})
    d = d.withColumn("even", F.floor(1000 * F.col("raw") / F.sum("raw").over(w) + 0.5) / 10)
    first = F.row_number().over(w.orderBy(F.desc("raw"), "trigger")) == 1
    p = F.when(F.col("wins") * 2 >= F.col("total"), binomial_tail(F.col("wins"), F.col("total"))).otherwise(binomial_tail(F.col("total") - F.col("wins"), F.col("total")))
    return d.select("trigger", "wins", "total", "rate", p.alias("p_value"), (F.col("even") + F.when(first, 100 - F.sum("even").over(w)).otherwise(0.0)).alias("weight"))


def validated_flows(lines: DataFrame) -> DataFrame:
    """(date, fii_net, dii_net, restated) of raw ``lines(date, line, fii_net, dii_net)``: what is no number is left out, and the last line of a date counts."""
    typed = lines.select("date", "line", *[F.col(c).try_cast("double").alias(c) for c in ("fii_net", "dii_net")]).where("date is not null and fii_net is not null and dii_net is not null")
    d = typed.groupBy("date").agg(F.max_by(F.struct("fii_net", "dii_net"), "line").alias("l"), F.count(F.lit(1)).alias("restated"))
    return d.select("date", "l.fii_net", "l.dii_net", "restated")


def verdicts(signals: DataFrame, model: str) -> DataFrame:
    """A model's verdict of each signal: action, confidence from 0 to 1, expected value in percent and whether it can be traded."""
    ev = F.when(F.col("entry") > 0, (F.col("target") / F.col("entry") - 1) * 100 * F.col("score") / 100 - (1 - F.col("stop") / F.col("entry")) * 100 * (1 - F.col("score") / 100))
    return signals.select("date", "symbol", F.lit(model).alias("model"), F.col("signal").alias("action"), (F.col("score") / 100).alias("confidence"), ev.alias("expected_net_ev_pct"), F.col("reject_reason").isNull().alias("liquidity_pass"))
