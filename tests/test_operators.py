"""Known answers, look-ahead and partition invariance of the panel operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.functions import expressions as X
from crossgrain.functions.frames import as_of, bucket, folded, percentile_rank, rounding
from crossgrain.operators import features, market, metrics, pit, quality, signals
from crossgrain.sources.bars import BAR, bars, normalized


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_percentile_and_buckets_average_ties(spark):
    d = spark.createDataFrame([(1, x) for x in (5.0, 5.0, 7.0, 9.0)], "date int, x double")
    got = sorted((r.x, r.p, r.b) for r in d.select("x", percentile_rank("x").alias("p"), bucket("x", 2).alias("b")).collect())
    assert got == [(5.0, 0.3, 0), (5.0, 0.3, 0), (7.0, 0.6, 1), (9.0, 0.8, 1)]


def test_planted_signal_has_perfect_rank_correlation(spark):
    rows = [(day(t), f"s{i}", float(i), float(i * i)) for t in range(10) for i in range(8)]
    p = spark.createDataFrame(rows, "date date, symbol string, score double, forward_return double")
    assert all(r.ic == pytest.approx(1.0) and r.names == 8 for r in metrics.rank_ic(p).collect())
    s = metrics.bucket_summary(p, 4, "date").first()
    assert s.monotonicity == pytest.approx(1.0) and s.rising_share == 1.0 and s.spread > 0
    flat = p.withColumn("score", F.lit(1.0))
    assert metrics.rank_ic(flat).count() == 0
    assert metrics.turnover(metrics.bucket_members(p, 4)).agg(F.max("turnover")).first()[0] == 0.0


def test_features_do_not_look_ahead(spark, sf):
    b = bars(spark, sf).where("symbol in ('1', '2')")
    cut = b.agg(F.percentile_approx(F.unix_date("date"), 0.6)).first()[0]
    names = ["sma_20", "donchian_upper_20", "return_5d", "volume_ratio_20"]
    build = lambda d: features.with_rsi(features.with_atr(features.with_features(d, names)))
    early = F.unix_date("date") <= cut
    key = lambda r: (r.symbol, r.date)
    assert sorted(build(b).where(early).collect(), key=key) == sorted(build(b.where(early)).collect(), key=key)


def test_fold_is_the_recursion(spark):
    rows = [("a", day(i), float(i)) for i in range(6)] + [("b", day(0), 4.0)]
    d = folded(spark.createDataFrame(rows, "symbol string, date date, x double"), F.lit(0.0), lambda s, x: s * 0.5 + x, F.col("x"))
    got = {(r.symbol, r.date): r.state for r in d.collect()}
    state = 0.0
    for i in range(6):
        state = state * 0.5 + i
        assert got["a", day(i)] == state
    assert got["b", day(0)] == 4.0


def test_folds_keep_rows_that_share_a_date(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0, "p"), ("a", dt.date(2020, 1, 1), 2.0, "q"), ("a", dt.date(2020, 1, 2), 4.0, None)]
    got = folded(spark.createDataFrame(rows, "symbol string, date date, x double, note string"), F.lit(0.0), lambda s, x: s + x, F.col("x"), chunk=2).collect()
    assert sorted((r.date.day, r.x, r.note or "", r.state) for r in got) == [(1, 1.0, "p", 1.0), (1, 2.0, "q", 3.0), (2, 4.0, "", 7.0)]


def test_splits_are_by_date_and_purged(spark):
    from crossgrain.operators.market import chronological_split

    rows = [(s, dt.date(2020, 1, d)) for s in "ab" for d in range(1, 21) if s == "a" or d > 10]
    got = {(r.symbol, r.date.day): r.role for r in chronological_split(spark.createDataFrame(rows, "symbol string, date date"), horizon=2).collect()}
    want = {d: "train" if d <= 12 else "validation" if d == 15 else "test" if d >= 18 else None for d in range(1, 21)}
    assert got == {(s, d.day): want[d.day] for s, d in rows if want[d.day]}


def test_as_of_takes_the_latest_known_value(spark):
    grid = spark.createDataFrame([("a", day(i)) for i in range(5)], "symbol string, date date")
    facts = spark.createDataFrame([("a", day(1), 1.0), ("a", day(3), None), ("a", day(4), 9.0)], "symbol string, at date, v double")
    assert [r.v for r in as_of(grid, facts, ["v"], at="at").orderBy("date").collect()] == [None, 1.0, 1.0, 1.0, 9.0]


def test_membership_keeps_rows_outside_its_coverage(spark):
    panel = spark.createDataFrame([("a", day(i)) for i in range(6)] + [("b", day(2))], "symbol string, date date")
    stays = spark.createDataFrame([("a", "x", day(2), day(3))], pit.MEMBERSHIP)
    assert sorted((r.symbol, r.date) for r in pit.apply_membership(panel, stays).collect()) == [("a", day(i)) for i in range(6)]


def test_one_fault_per_check(spark):
    rows = [("a", day(i), 10.0, 11.0, 9.0, 10.0, 5.0) for i in range(4)] + [("b", day(0), 10.0, 8.0, 9.0, 10.0, 5.0), ("c", day(0), 10.0, 11.0, 9.0, None, -5.0), ("d", day(0), 1.0, 1.0, 1.0, 1.0, 1.0), ("d", day(0), 1.0, 1.0, 1.0, 1.0, 1.0)]
    b = spark.createDataFrame(rows, BAR)
    found = {(r.check, r.symbol) for r in quality.report(b, least_history=1).collect()}
    assert {("high_below_body", "b"), ("high_below_low", "b"), ("non_positive_close", "c"), ("negative_volume", "c"), ("duplicate_date", "d")} <= found
    good, bad = quality.gated(b, quality.report(b, least_history=1))
    assert {r.symbol for r in good.select("symbol").distinct().collect()} == {"a"} and bad.count() == 4


def test_normalized_resolves_aliases_and_keeps_the_last_row(spark):
    raw = spark.createDataFrame([("2024-01-01", "10", "5", 1), ("2024-01-01", "12", "6", 2), ("bad", "1", "1", 3), ("2024-01-02", "x", None, 4)], "Date string, `Adj Close` string, VOL string, seq int")
    got = normalized(raw, symbol=F.lit("a"), sequence="seq").collect()
    assert [(r.date, r.close, r.volume, r.open) for r in got] == [(day(0), 12.0, 6.0, 12.0)]


def test_costs_and_levels(spark):
    assert X.round_trip() * 1e4 == pytest.approx(79.4, abs=0.05)
    d = spark.range(1).select(X.normal_cdf(F.lit(1.96)).alias("p"), X.net_reward_risk(F.lit(100.0), F.lit(90.0), F.lit(100.1), 0.01, 0.01).alias("r"), *[c.alias(n) for c, n in zip(X.stop_and_target(F.lit(100.0), F.lit(None).cast("double"), 1.5, 2.0), "st")], rounding(F.lit(2.675), 2).alias("q"))
    r = d.first()
    assert r.p == pytest.approx(0.975, abs=1e-4) and r.r == 0.0 and (r.s, r.t) == (98.0, 103.0)


def test_rejected_and_thin_dates_are_avoided(spark):
    rows = [(day(0), f"s{i}", float(i), 100.0, 2.0, 0.1, "locked" if i == 9 else None, 1.0, False) for i in range(10)] + [(day(1), "s1", 1.0, 100.0, 2.0, 0.1, None, 1.0, False)]
    p = spark.createDataFrame(rows, "date date, symbol string, metric double, close double, atr double, volatility double, reject_reason string, exposure double, blocked boolean")
    got = {(r.date, r.symbol): r for r in signals.rank_and_select(p, top=0.2, min_universe=5).collect()}
    assert got[day(0), "s9"].signal == got[day(1), "s1"].signal == "AVOID"
    assert [got[day(0), s].signal for s in ("s8", "s7", "s6")] == ["BUY", "BUY", "AVOID"] and got[day(0), "s8"].score == 100.0


def test_results_do_not_depend_on_partitions(spark, sf):
    p = bars(spark, sf).withColumns({"score": features.momentum(26, 4), "forward_return": features.forward_return(1)})
    take = lambda: sorted((r.date, round(r.ic, 9)) for r in metrics.rank_ic(metrics.validated(p)).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(take())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def plain_pair(x, y):
    """hedge, Dickey-Fuller t by least squares, spread mean and deviation."""
    hedge = (x @ y) / (y @ y)
    s = x - hedge * y
    design = np.column_stack([np.ones(len(s) - 1), s[:-1]])
    fit, *_ = np.linalg.lstsq(design, np.diff(s), rcond=None)
    rest = np.diff(s) - design @ fit
    error = np.sqrt(rest @ rest / (len(s) - 3) * np.linalg.inv(design.T @ design)[1, 1])
    return hedge, fit[1] / error, s.mean(), s.std(ddof=1)


@pytest.mark.parametrize("block", [256, 7])
def test_all_pairs_of_whole_histories_are_tested(spark, block):
    rng = np.random.default_rng(2)
    logs = {f"s{k}": 3 + np.cumsum(rng.normal(0, 0.02, 80)) for k in range(29)}
    logs["t0"] = 1.1 * logs["s7"] + rng.normal(0, 0.002, 80)  # tied to s7
    rows = [(s, day(i), float(np.exp(v))) for s, p in logs.items() for i, v in enumerate(p)] + [("gap", day(i), 5.0) for i in range(79)]
    tests = market.pair_tests(spark.createDataFrame(rows, "symbol string, date date, close double"), block)
    got = {(r.a, r.b): r for r in market.selected_pairs(tests).collect()}
    assert set(got) == {(a, b) for a in logs for b in logs if a < b}
    for (a, b), r in got.items():
        assert (r.hedge, r.t, r.spread_mean, r.spread_std) == pytest.approx(plain_pair(logs[a], logs[b]), rel=1e-6, abs=1e-9)
        assert not r.selected or r.p_value <= 0.05 / len(got)
    assert got["s7", "t0"].selected
    assert sum(r.selected for r in market.selected_pairs(tests, level=435.0, most=10).collect()) == 10
    assert market.cointegration_p(np.array([-3.90, -3.34, -3.04, 2.0, -30.0])) == pytest.approx([0.01, 0.05, 0.10, 1, 0], abs=2e-3)
