"""Row expressions: costs, stops, sizes, taxes and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding

#: The cost schedule of a delivery trade; fixed values, fractions of turnover but for the cap on brokerage.
BROKERAGE = 0.0003
BROKERAGE_MOST = 20.0
TRANSACTION_TAX = 0.001
EXCHANGE = 0.0000345
REGULATOR = 0.000001
SERVICE_TAX = 0.18
STAMP = 0.00015
SLIPPAGE = 0.0025
IMPACT_FROM = 0.01
IMPACT = 0.001
ATR_SHARE = 0.5
SHORT_TERM_TAX = 0.20
LONG_TERM_TAX = 0.125
EXEMPTION = 125_000.0
LONG_TERM_DAYS = 365


def cost_per_side(side: str, slippage: float = SLIPPAGE) -> float:
    """Friction of one leg as a fraction of turnover."""
    taxed = (BROKERAGE + EXCHANGE + REGULATOR) * (1 + SERVICE_TAX)
    return taxed + TRANSACTION_TAX + (STAMP if side == "BUY" else 0.0) + max(0.0, slippage)


def round_trip(slippage: float = SLIPPAGE) -> float:
    return cost_per_side("BUY", slippage) + cost_per_side("SELL", slippage)


def transaction_cost(side: Column, turnover: Column) -> Column:
    """Cost of an order in currency; nothing for no turnover."""
    brokerage = F.least(F.lit(BROKERAGE_MOST), turnover * BROKERAGE)
    fees = turnover * (EXCHANGE + REGULATOR)
    out = (brokerage + fees) * (1 + SERVICE_TAX) + turnover * TRANSACTION_TAX + F.when(side == "BUY", turnover * STAMP).otherwise(0.0)
    return F.when(turnover > 0, out).otherwise(0.0)


def slippage_and_impact(price: Column, quantity: Column, daily_volume: Column, atr: Column) -> Column:
    """Per share: half the true range, and a quadratic part of the price for what exceeds 1% of the day's volume."""
    excess = F.greatest(F.coalesce(F.try_divide(quantity, daily_volume), F.lit(0.0)) - IMPACT_FROM, F.lit(0.0))
    return ATR_SHARE * atr + IMPACT * excess * excess * price


def adjusted_price(side: Column, price: Column, slip: Column) -> Column:
    return F.when(side == "BUY", price + slip).otherwise(price - slip)


def stop_and_target(entry: Column, atr: Column, k_stop: float, k_target: float) -> tuple[Column, Column]:
    """Levels a multiple of the range away; 2% and 3% where it is unknown. The stop is at least 0."""
    known = atr > 0
    stop = F.when(known, F.greatest(entry - k_stop * atr, F.lit(0.0))).otherwise(entry * 0.98)
    return rounding(stop, 2), rounding(F.when(known, entry + k_target * atr).otherwise(entry * 1.03), 2)


def net_reward_risk(entry: Column, stop: Column, target: Column, buy: float, sell: float) -> Column:
    """Reward over risk after both legs' costs; 0 if either is not positive."""
    paid = entry * (1 + buy)
    reward, risk = target * (1 - sell) - paid, paid - stop * (1 - sell)
    return F.when((reward > 0) & (risk > 0), F.try_divide(reward, risk)).otherwise(0.0)


def net_return_pct(entry: Column, exit_: Column, buy: float, sell: float) -> Column:
    """Percent of money in, after costs."""
    return F.try_divide(exit_ * (1 - sell), entry * (1 + buy)) * 100 - 100


def volatility_scalar(volatility: Column, target: float, low: float = 0.25, high: float = 1.0) -> Column:
    """Exposure that brings a volatility to its target; 1 where it is unknown."""
    return F.coalesce(F.when(volatility > 0, F.least(F.greatest(F.lit(target) / F.when(volatility > 0, volatility), F.lit(low)), F.lit(high))), F.lit(1.0))


def risk_quantity(equity: Column, entry: Column, stop: Column, share: float, most: float) -> Column:
    """Shares that lose ``share`` of equity at the stop, within ``most`` of equity in money."""
    risk = entry - stop
    return F.when((risk > 0) & (entry > 0), F.floor(F.least(equity * share / F.when(risk > 0, risk), equity * most / F.when(entry > 0, entry)))).otherwise(0).cast("long")


def kelly_fraction(p: Column, win: Column, loss: Column) -> Column:
    """(p·g − q·l) / (g·l), the share of money; 0 where there is no edge."""
    edge = p * win - (1 - p) * loss
    return F.when((edge > 0) & (win > 0) & (loss > 0), edge / F.when((win > 0) & (loss > 0), win * loss)).otherwise(0.0)


def tax_on_gain(gain: Column, days: Column, exemption_used: Column) -> Column:
    """Short- and long-term tax; long-term gains first use what is left of the exemption."""
    left = F.greatest(F.lit(EXEMPTION) - exemption_used, F.lit(0.0))
    long = F.greatest(gain - left, F.lit(0.0)) * LONG_TERM_TAX
    return F.when(gain <= 0, 0.0).when(days >= LONG_TERM_DAYS, long).otherwise(gain * SHORT_TERM_TAX)


def failed_checks(**checks: Column) -> Column:
    """The names of the checks that are not true, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function (a rational approximation of the error function, error under 1.5e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)
