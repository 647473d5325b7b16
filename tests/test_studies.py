"""Draws, shuffles, splits of trials and lagged inputs."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.operators import features, studies


def test_draws_depend_on_seed_and_purpose(spark):
    symbols = spark.createDataFrame([(f"s{k}",) for k in range(200)] * 2, "symbol string")
    draw = lambda **k: [r.symbol for r in studies.seeded_symbols(symbols, 20, **k).collect()]
    one = draw(seed=1, purpose="a")
    assert one == draw(seed=1, purpose="a") and len(set(one)) == 20
    assert set(one) != set(draw(seed=2, purpose="a")) and set(one) != set(draw(seed=1, purpose="b"))


def test_shuffles_keep_each_dates_values(spark):
    rows = [(dt.date(2024, 1, 1 + k % 3), f"s{k}", float(k), k) for k in range(60)]
    d = spark.createDataFrame(rows, "date date, symbol string, score double, other int")
    got = studies.shuffled(d, "score", 5).collect()
    assert sorted((r.date, r.score) for r in got) == sorted((r[0], r[2]) for r in rows) and sorted((r.symbol, r.other) for r in got) == sorted((r[1], r[3]) for r in rows)
    assert sum(r.score == r.other for r in got) < 20


def test_overfitting_is_the_count_over_all_halves(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(24, 5))
    rows = [(f"t{j}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x[i, j])) for i in range(24) for j in range(5)]
    got = {r.split: r for r in studies.overfitting(spark.createDataFrame(rows, "trial string, date date, r double"), blocks=4).collect()}
    ratio = lambda rows: rows.mean(0) / rows.std(0, ddof=1)
    for k, near in enumerate(combinations(range(4), 2)):
        side = np.isin(np.arange(24) // 6, near)
        best, far = int(ratio(x[side]).argmax()), ratio(x[~side])
        rank = int((far <= far[best]).sum())
        assert (got[k].best, got[k]["rank"]) == (f"t{best}", rank) and got[k].logit == pytest.approx(np.log(rank / 6 / (1 - rank / 6)))


def test_gradient_is_the_slope(spark):
    rng = np.random.default_rng(1)
    p, y = rng.normal(size=9), rng.normal(size=9)
    d = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(p, y)], "date int, score double, forward_return double")
    got = {r.score: r for r in studies.ic_gradient(d).collect()}
    for i in range(9):
        moved = p + 1e-6 * (np.arange(9) == i)
        assert got[p[i]].gradient == pytest.approx((np.corrcoef(moved, y)[0, 1] - np.corrcoef(p, y)[0, 1]) / 1e-6, abs=1e-4)


def test_inputs_are_a_row_old(spark):
    d = spark.createDataFrame([("a", dt.date(2024, 1, k), float(k)) for k in (1, 2, 3)] + [("b", dt.date(2024, 1, 2), 7.0)], "symbol string, date date, close double")
    got = {(r.symbol, r.date.day): r.same for r in features.cross_sectional(d, ["close"], {"same": lambda c: c["close"]}).collect()}
    assert got == {("a", 1): None, ("a", 2): 1.0, ("a", 3): 2.0, ("b", 1): None, ("b", 2): None, ("b", 3): 7.0}
    with pytest.raises(ValueError):
        features.cross_sectional(d, ["close"], {}, lag=0)


def test_sector_room_and_caveats(spark):
    rows = [(dt.date(2024, 1, 1), s, "x", "BUY", score, 100.0, 90.0, 1.0) for s, score in (("a", 90.0), ("b", 80.0), ("c", 70.0), ("d", 60.0))]
    d = spark.createDataFrame(rows, "date date, symbol string, sector string, signal string, score double, entry double, stop double, position_scale double")
    got = studies.recommendations(d, equity=1000.0, position=0.1, sector=0.25, risk=0.5).collect()
    assert [(r.symbol, r.quantity, r.compliance) for r in got] == [("a", 1, "passed"), ("b", 1, "passed"), ("c", 0, "quantity"), ("d", 0, "quantity")]
    run = spark.createDataFrame([(1.0, -1.0, 0, 1.0, -1.0, False, True)], "gross double, net double, rebalances int, up_ic double, down_ic double, members boolean, fundamentals boolean")
    assert studies.caveats(run).select(F.col("codes")).first()[0] == "survivorship,no_rebalances,cost_not_survived,state_dependent"
