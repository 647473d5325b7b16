"""Queries over row expressions: costs, sizes, taxes and checks of orders (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.frames import rounding
from crossgrain.functions import expressions as X
from crossgrain.plans.common import sql
from crossgrain.plans.registry import query
from crossgrain.sources.bars import table

ORDERS = """od AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_extendedprice / l_quantity AS price, l_quantity AS quantity, 500 + l_suppkey % 1000 AS adv, (l_extendedprice / l_quantity) * (0.01 + 0.04 * l_discount) AS atr, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) % 800 AS days FROM lineitem)"""


def orders(spark, sf) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), price.alias("price"), F.col("l_quantity").alias("quantity"),
        (500 + F.col("l_suppkey") % 1000).alias("adv"), (price * (0.01 + 0.04 * F.col("l_discount"))).alias("atr"), (F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")) % 800).alias("days"),
    )


KEYS = ("order_id", "line", "part")
K = "order_id, line, part"


def shown(d: DataFrame, digits: int = 4, **cols) -> DataFrame:
    kinds = dict(d.withColumns(cols).dtypes)
    return d.select(*KEYS, *[(rounding(c, digits) if kinds[n] == "double" else c).alias(n) for n, c in cols.items()])


LEVELS = "lv AS (SELECT *, round(CASE WHEN atr > 0 THEN greatest(price - 1.5 * atr, 0.0) ELSE price * 0.98 END, 2) AS stop, round(CASE WHEN atr > 0 THEN price + 2.0 * atr ELSE price * 1.03 END, 2) AS target FROM od)"
BUY, SELL = X.cost_per_side("BUY"), X.cost_per_side("SELL")
RR = f"(CASE WHEN target * (1 - {SELL!r}) > price * (1 + {BUY!r}) AND price * (1 + {BUY!r}) > stop * (1 - {SELL!r}) THEN (target * (1 - {SELL!r}) - price * (1 + {BUY!r})) / (price * (1 + {BUY!r}) - stop * (1 - {SELL!r})) ELSE 0 END)"


def levels(d: DataFrame) -> DataFrame:
    stop, target = X.stop_and_target(F.col("price"), F.col("atr"), 1.5, 2.0)
    return d.withColumns({"stop": stop, "target": target})


@query("P10_stop_and_target", sql(ORDERS, LEVELS, select=f"SELECT {K}, round(stop, 1) AS stop, round(target, 1) AS target FROM lv"))
def p10(spark, sf):
    d = levels(orders(spark, sf))
    return shown(d, 1, stop=F.col("stop"), target=F.col("target"))


@query("P11_net_reward_risk", sql(ORDERS, LEVELS, select=f"SELECT {K}, round({RR}, 2) AS reward_risk FROM lv"))
def p11(spark, sf):
    return shown(levels(orders(spark, sf)), 2, reward_risk=X.net_reward_risk(F.col("price"), F.col("stop"), F.col("target"), BUY, SELL))


@query("P13_cost_fractions", sql(ORDERS, select=f"SELECT side, count(*) AS orders, CAST({round(BUY, 9)!r} AS DOUBLE) AS buy, CAST({round(SELL, 9)!r} AS DOUBLE) AS sell, CAST({round(X.round_trip(), 9)!r} AS DOUBLE) AS round_trip FROM od GROUP BY side"))
def p13(spark, sf):
    return orders(spark, sf).groupBy("side").agg(F.count(F.lit(1)).alias("orders"), F.first(F.lit(round(BUY, 9))).alias("buy"), F.first(F.lit(round(SELL, 9))).alias("sell"), F.first(F.lit(round(X.round_trip(), 9))).alias("round_trip"))


COST = "CASE WHEN price * quantity > 0 THEN (least(20.0, price * quantity * 0.0003) + price * quantity * (0.0000345 + 0.000001)) * 1.18 + price * quantity * 0.001 + CASE WHEN side = 'BUY' THEN price * quantity * 0.00015 ELSE 0 END ELSE 0 END"


@query("P14_transaction_costs", sql(ORDERS, select=f"SELECT {K}, round({COST}, 4) AS cost FROM od"))
def p14(spark, sf):
    return shown(orders(spark, sf), cost=X.transaction_cost(F.col("side"), F.col("price") * F.col("quantity")))


SLIP = "(0.5 * atr + 0.001 * pow(greatest(quantity / adv - 0.01, 0), 2) * price)"


@query("P15_slippage", sql(ORDERS, select=f"SELECT {K}, round(CASE WHEN side = 'BUY' THEN price + {SLIP} ELSE price - {SLIP} END, 4) AS fill, 3.0 * atr * quantity > {COST} + {SLIP} * quantity AS execute FROM od"))
def p15(spark, sf):
    d = orders(spark, sf)
    slip = X.slippage_and_impact(F.col("price"), F.col("quantity"), F.col("adv"), F.col("atr"))
    friction = X.transaction_cost(F.col("side"), F.col("price") * F.col("quantity")) + slip * F.col("quantity")
    return shown(d, fill=X.adjusted_price(F.col("side"), F.col("price"), slip), execute=3.0 * F.col("atr") * F.col("quantity") > friction)


SIZE = "CASE WHEN price - stop > 0 THEN CAST(floor(least(1000000.0 * 0.01 / (price - stop), 1000000.0 * 0.1 / price)) AS BIGINT) ELSE 0 END"


@query("P16_risk_quantity", sql(ORDERS, LEVELS, select=f"SELECT {K}, {SIZE} AS shares, round({SIZE} * (price - stop), 4) AS max_loss FROM lv"))
def p16(spark, sf):
    d = levels(orders(spark, sf)).withColumn("shares", X.risk_quantity(F.lit(1e6), F.col("price"), F.col("stop"), 0.01, 0.1))
    return shown(d, shares=F.col("shares"), max_loss=F.col("shares") * (F.col("price") - F.col("stop")))


PROB = "(days / 800.0)"
KELLY = f"(CASE WHEN {PROB} * 0.08 - (1 - {PROB}) * 0.05 > 0 THEN ({PROB} * 0.08 - (1 - {PROB}) * 0.05) / (0.08 * 0.05) ELSE 0 END)"


@query("P17_kelly", sql(ORDERS, LEVELS, select=f"SELECT {K}, round({KELLY}, 6) AS fraction, least(CAST(floor(least({KELLY} * 0.25, 1.0, 0.1) * 1000000 / price) AS BIGINT), {SIZE}) AS shares FROM lv"))
def p17(spark, sf):
    d = levels(orders(spark, sf)).withColumn("f", X.kelly_fraction(F.col("days") / 800.0, F.lit(0.08), F.lit(0.05)))
    kelly = F.floor(F.least(F.col("f") * 0.25, F.lit(1.0), F.lit(0.1)) * 1_000_000 / F.col("price")).cast("long")
    d = d.withColumn("shares", F.least(kelly, X.risk_quantity(F.lit(1e6), F.col("price"), F.col("stop"), 0.01, 0.1)))
    return shown(d, 6, fraction=F.col("f"), shares=F.col("shares"))


@query("P18_scaled_quantity", sql(ORDERS, select=f"SELECT {K}, CAST(floor(quantity * greatest(0, least(1, (days - 200) / 400.0))) AS BIGINT) AS scaled FROM od"))
def p18(spark, sf):
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("days") - 200) / 400.0))
    return shown(orders(spark, sf), scaled=F.floor(F.col("quantity") * scale).cast("long"))


@query("P19_volatility_scalar", sql(ORDERS, select=f"SELECT {K}, round(coalesce(CASE WHEN atr > 0 THEN least(greatest(15.0 / atr, 0.25), 1.0) END, 1.0), 6) AS scalar FROM od"))
def p19(spark, sf):
    return shown(orders(spark, sf), 6, scalar=X.volatility_scalar(F.col("atr"), 15.0))


@query("P20_tax", sql(ORDERS, select=f"SELECT {K}, round(CASE WHEN atr * quantity * 10 - 200 <= 0 THEN 0 WHEN days >= 365 THEN greatest(atr * quantity * 10 - 200 - greatest(125000.0 - days * 160, 0), 0) * 0.125 ELSE (atr * quantity * 10 - 200) * 0.2 END, 4) AS tax FROM od"))
def p20(spark, sf):
    return shown(orders(spark, sf), tax=X.tax_on_gain(F.col("atr") * F.col("quantity") * 10 - 200, F.col("days"), F.col("days") * 160))


CHECKS = {"price_floor": ("price >= 1000.0", lambda: F.col("price") >= 1000.0), "quantity": ("quantity > 5", lambda: F.col("quantity") > 5), "position_cap": ("price * quantity <= 60000", lambda: F.col("price") * F.col("quantity") <= 60000), "derivative": ("side <> 'SELL'", lambda: F.col("side") != "SELL")}
FAILED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT ({c}) THEN '{k}' END" for k, (c, _) in CHECKS.items()) + "], lambda x: x IS NOT NULL), ',')"


@query("P7_compliance_gate", sql(ORDERS, select=f"SELECT {K}, {FAILED} AS failed, {FAILED} = '' AS passed FROM od"))
def p7(spark, sf):
    d = orders(spark, sf).withColumn("f", X.failed_checks(**{k: c() for k, (_, c) in CHECKS.items()}))
    return shown(d, failed=F.array_join("f", ","), passed=F.size("f") == 0)


@query("P9_compliance_summary", sql(ORDERS, select="SELECT count(*) AS orders, " + ", ".join(f"count(*) FILTER (WHERE NOT ({c})) AS {k}" for k, (c, _) in CHECKS.items()) + " FROM od"))
def p9(spark, sf):
    return orders(spark, sf).agg(F.count(F.lit(1)).alias("orders"), *[F.count_if(~c()).alias(k) for k, (_, c) in CHECKS.items()])


@query("P8_recommendation_check", sql(ORDERS, LEVELS, "hd AS (SELECT order_id, sum(price * quantity) AS held FROM od GROUP BY order_id)", select=f"SELECT {K}, price >= 1000 AS price_ok, part % 10 <> 0 AS allowed, held <= 300000 AS concentration_ok, {RR} >= 1.0 AS reward_ok FROM lv JOIN hd USING (order_id)"))
def p8(spark, sf):
    d = levels(orders(spark, sf))
    held = d.groupBy("order_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("held"))
    d = d.join(held, "order_id")
    return shown(d, price_ok=F.col("price") >= 1000, allowed=F.col("part") % 10 != 0, concentration_ok=F.col("held") <= 300000, reward_ok=X.net_reward_risk(F.col("price"), F.col("stop"), F.col("target"), BUY, SELL) >= 1.0)


@query("G29_sector_exposure", """WITH x AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'UNKNOWN' ELSE n_name END AS sector, sum(CAST(floor(s_acctbal * 100 + 0.5) AS BIGINT)) AS cents FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), t AS (SELECT sum(cents) AS total FROM x)
 SELECT sector, CAST(cents AS DOUBLE) / 100 AS exposure, CAST(greatest(0, CASE WHEN sector = 'UNKNOWN' THEN 30 ELSE 25 END * total // 100 - cents) AS DOUBLE) / 100 AS capacity FROM x, t""")
def g29(spark, sf):
    d = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    d = d.groupBy(F.when(F.col("s_suppkey") % 10 == 0, "UNKNOWN").otherwise(F.col("n_name")).alias("sector")).agg(F.sum(F.floor(F.col("s_acctbal") * 100 + 0.5)).alias("cents"))  # whole cents, which add up alike in any order
    total = d.agg(F.sum("cents").alias("total"))
    share = F.when(F.col("sector") == "UNKNOWN", 30).otherwise(25)
    left = F.greatest(F.lit(0), F.floor(share * F.col("total") / 100) - F.col("cents"))
    return d.crossJoin(F.broadcast(total)).select("sector", (F.col("cents") / 100).alias("exposure"), (left / 100).alias("capacity"))
