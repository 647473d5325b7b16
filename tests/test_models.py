"""Several exposures, rolling pairs, first touches and rank-IC boosting against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.operators import books, boosting, calibration, exposures, gram, market, planner, studies, training
from crossgrain.sources.bars import store_bars

DAY = dt.date(2024, 1, 1)
day = lambda k: DAY + dt.timedelta(days=int(k))


# ---- exposures -----------------------------------------------------------------------------------


def plain_residual(y, x, groups):
    design = np.column_stack([np.ones(len(y)), x, *[(np.array(groups) == g).astype(float) for g in sorted(set(groups))]])
    left = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    return np.zeros_like(left) if np.sqrt((left**2).mean()) <= 1e-8 * y.std() else left


@pytest.mark.parametrize("grouped", [True, False])
def test_residuals_are_least_squares(spark, grouped):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(8):
        n = [40, 40, 40, 7, 40, 40, 40, 40][d]
        x = rng.normal(size=(n, 3)) * [1, 1e4, 1e-3]
        if d == 1:
            x[:, 2] = 2 * x[:, 0]  # repeated
        if d == 2:
            x[:, 1] = 5.0  # constant
        y = rng.normal(size=n) + x[:, 0]
        if d == 4:
            y = 3 + x @ [1, -2, 0.5]  # explained whole
        if d == 5:
            x[3, 1] = np.inf
        if d == 6:
            y = np.full(n, 2.0)
        rows += [(day(d), f"s{i}", float(y[i]), *map(float, x[i]), "abc"[i % 3], i) for i in range(n)]
    rows += [(day(0), "no score", None, 0.0, 0.0, 0.0, "a", 0), (day(0), "no exposure", 1.0, None, 0.0, 0.0, "a", 0)]
    panel = spark.createDataFrame(rows, "date date, symbol string, score double, x0 double, x1 double, x2 double, sector string, n int")
    got = exposures.neutralized(panel, ["x0", "x1", "x2"], group="sector" if grouped else None).collect()
    by_date = {d: [r for r in got if r.date == day(d)] for d in range(8)}
    assert not by_date[5] and bool(by_date[3]) is (not grouped)  # infinite; 7 names are enough for k = 3, not for 3 and 3 sectors
    for d in (0, 1, 2, 4, 6, 7):
        own = sorted(by_date[d], key=lambda r: r.n)
        assert len(own) == 40 and {r.symbol for r in own}.isdisjoint({"no score", "no exposure"})
        want = plain_residual(np.array([r.score for r in own]), np.array([[r.x0, r.x1, r.x2] for r in own]), [r.sector if grouped else "" for r in own])
        assert np.allclose([r.residual for r in own], want, atol=1e-7)
    assert {r.residual for r in by_date[4]} == {0.0}


def test_residuals_without_exposures_are_demeaned(spark):
    panel = spark.createDataFrame([(DAY, f"s{i}", float(i), None if i < 3 else "b") for i in range(8)], "date date, symbol string, score double, sector string")
    got = {r.symbol: r.residual for r in exposures.neutralized(panel, [], group="sector", min_names=1).collect()}
    assert got == {f"s{i}": i - (1.0 if i < 3 else 5.0) for i in range(8)}
    assert exposures.neutralized(panel.where("false"), ["score"]).collect() == []


# ---- pairs ---------------------------------------------------------------------------------------


def walks(seed=3, symbols=7, sessions=90):
    rng = np.random.default_rng(seed)
    base = np.cumsum(rng.normal(size=sessions)) * 0.01 + 4
    return {f"s{k}": np.exp((base if k < 3 else np.cumsum(rng.normal(size=sessions)) * 0.01 + 4) + rng.normal(size=sessions) * 0.01) for k in range(symbols)}


def price_rows(spark, closes):
    return spark.createDataFrame([(s, day(i), float(v)) for s, c in closes.items() for i, v in enumerate(c)], "symbol string, date date, close double")


def plain_rolling(closes, formation, refresh, most):
    names, out = sorted(closes), {}
    logs = {s: np.log(c) for s, c in closes.items()}
    sessions = len(next(iter(closes.values())))
    for start in range(formation, sessions, refresh):
        found = []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                x, y = logs[a][start - formation : start], logs[b][start - formation : start]
                s = x - (hedge := (x @ y) / (y @ y)) * y
                ds, s0 = np.diff(s), s[:-1]
                design = np.column_stack([np.ones(len(s0)), s0])
                coef, rest, *_ = np.linalg.lstsq(design, ds, rcond=None)
                t = coef[1] / np.sqrt(rest[0] / (len(s0) - 2) / ((s0 - s0.mean()) ** 2).sum())
                found.append((np.floor(t * 1e6 + 0.5), a, b, hedge, s.mean(), s.std(ddof=1)))
        for _, a, b, hedge, m, sd in sorted(found)[:most]:
            for k in range(start, min(start + refresh, sessions)):
                z = (logs[a][k] - hedge * logs[b][k] - m) / sd
                out.setdefault((day(k), a), []).append(-z)
                out.setdefault((day(k), b), []).append(z)
    return {k: (np.mean(v), len(v)) for k, v in out.items()}


def test_rolling_pairs_are_the_loop(spark):
    closes = walks()
    got = {(r.date, r.symbol): (r.cheapness, r.pairs) for r in studies.rolling_pair_scores(price_rows(spark, closes), formation=40, refresh=15, level=None, most=4).collect()}
    want = plain_rolling(closes, 40, 15, 4)
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0], abs=1e-6) and got[k][1] == want[k][1] for k in want)


def test_rolling_pairs_do_not_see_the_future(spark):
    closes = walks(5)
    other = {s: np.where(np.arange(len(c)) >= 70, c * (1.5 + k / 3), c) for k, (s, c) in enumerate(closes.items())}
    a, b = ({(r.date, r.symbol): r.cheapness for r in studies.rolling_pair_scores(price_rows(spark, c), formation=40, refresh=15, level=0.5, most=3).where(F.col("date") < F.lit(day(70))).collect()} for c in (closes, other))
    assert a and a == b
    assert studies.rolling_pair_scores(price_rows(spark, walks(sessions=30)), formation=40, refresh=15).collect() == []


# ---- first touches -------------------------------------------------------------------------------


@pytest.mark.parametrize("fanout, horizon", [(2, None), (3, 40), (64, None)])
def test_first_touch_is_the_scan(spark, fanout, horizon):
    rng = np.random.default_rng(fanout)
    rows, signals = [], []
    for s in "ab":
        close = 100 + np.cumsum(rng.normal(size=150))
        for i, c in enumerate(close):
            low, high = c - rng.random(), c + rng.random()
            rows.append((s, day(i), float(c), float(high) if i % 17 else None, float(low), float(c), 1.0))
            if i % 3 == 0:
                signals.append((s, day(i), float(c - rng.random() * 12), float(c + rng.random() * 30)))
    signals.append(("none", day(3), 1.0, 2.0))
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    got = {(r.symbol, r.date): r for r in books.barrier_exits(spark.createDataFrame(signals, "symbol string, date date, stop double, target double"), bars, horizon, fanout=fanout).collect()}
    series = {s: [r for r in rows if r[0] == s] for s in "ab"}
    seen = set()
    for s, d, stop, target in signals[:-1]:
        at = (d - DAY).days + 1
        if at == len(series[s]):
            assert (s, d) not in got
            continue
        hit = next((r for r in series[s][at:] if r[4] <= stop or (r[3] is not None and r[3] >= target)), None)
        if hit and horizon and (hit[1] - series[s][at][1]).days > horizon:
            hit = None
        r = got[s, d]
        want = ("open", None, None) if hit is None else ("stop", hit[1], min(hit[2], stop)) if hit[4] <= stop else ("target", hit[1], max(hit[2], target))
        assert (r.exit_reason, r.exit_date, r.exit_price) == want
        seen.add(want[0])
    assert len(got) == len(signals) - 1 - sum(d == day(149) for _, d, *_ in signals) and seen == {"open", "stop", "target"}


def test_first_touch_has_no_join_of_signals_with_all_bars(spark):
    bars = spark.range(0, 2000).selectExpr("concat('s', cast(id % 1 as string)) as symbol", "date_add(date'2000-01-01', int(id)) as date", "100d as open", "101d as high", "99d as low", "100d as close", "1d as volume")
    signals = bars.selectExpr("symbol", "date", "50d as stop", "150d as target")
    found = books.barrier_exits(signals, bars, fanout=16)
    rows = found.collect()
    assert len(rows) == 1999 and {r.exit_reason for r in rows} == {"open"}
    spans = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in spans and "NestedLoop" not in spans


def test_closing_out_is_the_first_close_in_time(spark):
    bars = spark.createDataFrame([("a", day(k), None if k == 30 else float(k)) for k in range(0, 100, 10)], "symbol string, date date, close double")
    trades = spark.createDataFrame([("a", day(10), 1.0), ("a", day(11), 1.0), ("a", day(75), 1.0), ("b", day(0), 1.0), ("a", day(10), 2.0)], "symbol string, entry_date date, entry double")
    got = sorted((r.symbol, r.entry_date, r.entry, r.exit_date, r.exit) for r in books.closed_out(trades, bars).collect())
    assert got == [("a", day(10), 1.0, day(40), 40.0), ("a", day(10), 2.0, day(40), 40.0), ("a", day(11), 1.0, day(40), 40.0), ("a", day(75), 1.0, None, None), ("b", day(0), 1.0, None, None)]


# ---- boosting ------------------------------------------------------------------------------------


def plain_tree(x, g, depth, least):
    """Rows' predictions of a least-squares tree; the midpoint between two values is the cut."""
    out = np.full(len(g), g.mean())
    if not depth or len(g) < 2 * least:
        return out, None
    best = (1e-12, None, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for a, b in zip(values, values[1:]):
            left = x[:, j] <= (a + b) / 2
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = g.var() - left.mean() * g[left].var() - (~left).mean() * g[~left].var()
            if gain > best[0]:
                best = (gain, j, (a + b) / 2)
    if best[1] is None:
        return out, None
    left = x[:, best[1]] <= best[2]
    halves = [plain_tree(x[m], g[m], depth - 1, least) for m in (left, ~left)]
    for m, (p, _) in zip((left, ~left), halves):
        out[m] = p
    return out, (best[1], best[2], halves[0][1], halves[1][1])


def planted(seed=1, dates=24, names=30):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        x = rng.integers(0, 12, size=(names, 3)) / 4
        y = x[:, 0] - 0.5 * (x[:, 1] > 1) + rng.normal(size=names) * 0.7 + rng.normal() * 3
        role = "train" if d < 16 else "validation"
        rows += [(day(d), f"s{i}", role, *map(float, x[i]), float(y[i])) for i in range(names)]
    return rows


def test_boosting_is_the_loop(spark):
    rows = planted()
    panel = boosting.rank_label(spark.createDataFrame(rows, "date date, symbol string, role string, a double, b double, c double, forward_return double"))
    model = boosting.rank_ic_boosted(panel, ["a", "b", "c"], rounds=5, rate=0.3, depth=2, least=10, patience=9)
    train = [r for r in rows if r[2] == "train"]
    x, dates = np.array([r[3:6] for r in train]), np.array([(r[0] - DAY).days for r in train])
    y = np.empty(len(train))
    for d in set(dates):
        own = np.array([r[6] for r in train])[dates == d]
        y[dates == d] = 2 * (own.argsort().argsort() + 1) / (len(own) + 1) - 1
    s = np.zeros(len(train))
    for number, objective, _ in model.history:
        g = np.empty(len(s))
        for d in set(dates):
            m = dates == d
            u, v = s[m] - s[m].mean(), y[m] - y[m].mean()
            v = v / np.linalg.norm(v)
            g[m] = v if np.linalg.norm(u) < 1e-12 else v - (u @ v) / (u @ u) * u
        s += 0.3 * plain_tree(x, g, 2, 10)[0]
        assert objective == pytest.approx(np.mean([np.corrcoef(s[dates == d], y[dates == d])[0, 1] for d in set(dates)]), abs=1e-6)
    objectives = [o for _, o, _ in model.history]
    assert objectives == sorted(objectives) and objectives[0] < objectives[-1]
    assert model.kept == max(model.history, key=lambda h: h[2])[0]
    scored = {(r.date, r.symbol): r.score for r in model.scored(panel.withColumn("extra", F.lit(1))).collect()}
    if model.kept == len(model.trees):
        assert np.allclose([scored[r[0], r[1]] for r in train], s, atol=1e-6)
    lacking = model.scored(panel.limit(1).withColumn("a", F.lit(None).cast("double"))).collect()
    assert [r.score for r in lacking] == [None]


def test_gradients_of_flat_scores_and_labels(spark):
    rows = [(DAY, f"s{i}", 0.0, float(i)) for i in range(5)] + [(day(1), f"s{i}", float(i), 1.0) for i in range(5)]
    got = boosting.ascent(spark.createDataFrame(rows, "date date, symbol string, score double, target double")).collect()
    assert np.allclose([r.gradient for r in got if r.date == DAY], (np.arange(5) - 2) / np.sqrt(10)) and {r.gradient for r in got if r.date != DAY} == {0.0}


# ---- covariances ---------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 256])
def test_covariances_are_those_of_common_dates(spark, block):
    rng = np.random.default_rng(8)
    x = np.where(rng.random((40, 8)) < 0.3, np.nan, rng.normal(size=(40, 8)) + 5)
    x[:, 6], x[1:, 7] = np.nan, np.nan
    rows = [(day(d), f"s{j}", None if np.isnan(x[d, j]) else float(x[d, j])) for d in range(40) for j in range(8)]
    returns = spark.createDataFrame(rows, "date date, symbol string, ret double")
    got = {(r.i, r.j): r.cov for r in gram.covariance(returns, block).collect()}
    weighted = {(r.i, r.j): r.cov for r in gram.exponential_covariance(returns.where("ret is not null"), 5.0, block).collect()}
    w = 0.5 ** (np.arange(39, -1, -1) / 5)
    w = w / w.sum()
    seen = set()
    for i in range(8):
        for j in range(8):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if not both.any():
                continue
            seen.add((f"s{i}", f"s{j}"))
            want = np.cov(x[both, i], x[both, j])[0, 1] if both.sum() > 1 else None
            assert got[f"s{i}", f"s{j}"] == (None if want is None else pytest.approx(want, abs=1e-9))
            a, b = (x[both, k] - np.nansum(w * x[:, k]) for k in (i, j))
            assert weighted[f"s{i}", f"s{j}"] == pytest.approx((w[both] * a * b).sum() / (1 - (w[both] ** 2).sum()), abs=1e-9)
    assert got.keys() == weighted.keys() == seen
    assert gram.covariance(returns.where("false"), block).collect() == []


# ---- augmented tests -----------------------------------------------------------------------------


def plain_augmented(s, most):
    change = np.diff(s)

    def fit(lag, first):
        y = change[first:]
        x = np.column_stack([np.ones(len(y)), s[first:-1], *[change[first - k : len(change) - k] for k in range(1, lag + 1)]])
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        left = ((y - x @ b) ** 2).sum()
        return left, len(y), b[1] / np.sqrt(left / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])

    scores = [n * np.log(left / n) + 2 * (lag + 2) for lag in range(most + 1) for left, n, _ in [fit(lag, most)]]
    lag = int(np.argmin(scores))
    return fit(lag, lag)[2], lag


def test_augmented_statistics_are_the_regressions(spark):
    rng = np.random.default_rng(6)
    spreads = np.cumsum(rng.normal(size=(200, 90)), 1) * (rng.random((200, 1)) < 0.5) + rng.normal(size=(200, 90))
    spreads[::3] = np.cumsum(spreads[::3], 1) * 1e-3 + 7
    t, lags = market.augmented(spreads, 6)
    want = [plain_augmented(s, 6) for s in spreads]
    assert np.allclose(t, [w[0] for w in want], atol=1e-6) and lags.tolist() == [w[1] for w in want] and len(set(lags)) > 3
    closes = walks()
    got = {(r.a, r.b): r for r in market.pair_tests(price_rows(spark, closes), lags=5).collect()}
    for (a, b), r in got.items():
        x, y = np.log(closes[a]), np.log(closes[b])
        assert (r.t, r.lags) == (pytest.approx(plain_augmented(x - (x @ y) / (y @ y) * y, 5)[0], abs=1e-5), plain_augmented(x - (x @ y) / (y @ y) * y, 5)[1])
    assert len(got) == 21


# ---- calibration ---------------------------------------------------------------------------------


def plain_isotonic(x, y):
    blocks = []
    for v in np.unique(x):
        blocks.append([[v], list(y[x == v])])
        while len(blocks) > 1 and np.mean(blocks[-2][1]) >= np.mean(blocks[-1][1]):
            a, b = blocks.pop(-2), blocks.pop(-1)
            blocks.append([a[0] + b[0], a[1] + b[1]])
    return [(b[0][0], b[0][-1], np.mean(b[1])) for b in blocks]


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_calibration_pools_as_the_loop(spark, ranges):
    rng = np.random.default_rng(ranges)
    x = np.round(rng.normal(size=600), 2)
    y = (rng.random(600) < 1 / (1 + np.exp(-2 * x))).astype(float)
    rows = spark.createDataFrame([*((float(a), float(b)) for a, b in zip(x, y)), (None, 1.0), (0.1, None), (float("nan"), 1.0), (float("inf"), 0.0)], "score double, outcome double")
    fit = calibration.fitted(rows.repartition(4), ranges=ranges)
    want = plain_isotonic(x, y)
    xs, ys = zip(*[(v, p) for a, b, p in want for v in ((a, b) if b > a else (a,))])
    assert fit.samples == 600 and np.allclose(fit.scores, xs) and np.allclose(fit.rates, ys)
    asked = spark.createDataFrame([(v, k) for k, v in enumerate([-9.0, 0.005, 9.0, None])], "score double, k int")
    got = {r.k: r.p for r in fit.calibrated(asked).collect()}
    assert [got[k] for k in range(3)] == pytest.approx(list(np.interp([-9.0, 0.005, 9.0], xs, ys))) and got[3] is None


def test_calibration_needs_outcomes_of_both_kinds(spark):
    few = spark.range(0, 99).selectExpr("cast(id as double) as score", "cast(id % 2 as double) as outcome")
    alike = spark.range(0, 500).selectExpr("cast(id as double) as score", "1d as outcome")
    assert calibration.fitted(few) is None and calibration.fitted(alike) is None and calibration.fitted(few.where("false")) is None
    assert calibration.fitted(few, least=99).samples == 99


# ---- walk-forward --------------------------------------------------------------------------------


def test_walk_forward_trains_on_the_past_only(spark):
    rows = [(r[0], r[1], *r[3:6], r[6]) for r in planted(dates=40, names=12)]
    panel = boosting.rank_label(spark.createDataFrame(rows, "date date, symbol string, a double, b double, c double, forward_return double"))
    later = panel.withColumn("target", F.when(F.col("date") >= F.lit(day(24)), -F.col("target")).otherwise(F.col("target")))
    settings = [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 3, "maxDepth": 1}]
    one, two = ({(r.setting, r.fold, r.date, r.symbol): r.p for r in training.walk_forward(d, ["a", "b", "c"], settings, folds=4, embargo=1).collect()} for d in (panel, later))
    assert {k[:2] for k in one} == {(s, f) for s in (0, 1) for f in (1, 2, 3, 4)} and len(one) == 2 * 32 * 12 == len({(k[0], *k[2:]) for k in one})
    assert all(two[k] == v for k, v in one.items() if k[2] < day(24)) and any(two[k] != v for k, v in one.items() if k[1] == 4)
    p = training.walk_forward(panel, ["a", "b", "c"], settings, folds=2)
    m = training.measured(p, "setting", "fold").collect()
    own = [r for r in p.collect() if (r.setting, r.fold) == (0, 1)]
    r = next(r for r in m if (r.setting, r.fold) == (0, 1))
    assert r.rows == len(own) and r.mse == pytest.approx(np.mean([(x.p - x.target) ** 2 for x in own])) and r.mean_ic > 0.2 and r.t is not None
    best = training.ranked(training.measured(p, "setting", "fold")).orderBy("place").collect()
    assert [b.place for b in best] == [1, 2] and best[0].mean_ic >= best[1].mean_ic and best[0].folds == 2
    assert training.walk_forward(panel.where("false"), ["a"], settings).collect() == []


# ---- features by name ----------------------------------------------------------------------------


def exchanges(df, column):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return sum(line.lstrip(" :+-*()0123456789").startswith("Exchange hashpartitioning(" + column) for line in final.splitlines())


def some_bars(spark, sessions=300, symbols=6):
    return spark.range(sessions * symbols).selectExpr(f"concat('s', id % {symbols}) as symbol", f"date_add(date'2020-01-01', cast(id div {symbols} as int)) as date", "50d + id % 7 as open", "60d + id % 5 as high", "40d as low", "50d + (id * id) % 11 as close", "100d + id % 13 as volume")


def test_planned_features_share_their_shuffles(spark, tmp_path):
    some_bars(spark).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    asked = ["sma_20", "rsi_14", "atr_14", "traded_value_60", *planner.SETS["relative"]]
    d = planner.planned(bars, asked)
    assert exchanges(d, "symbol") == 1 and exchanges(d, "date") == 1 and d.columns == ["symbol", "date", *asked]
    store = store_bars(bars, "planned_store", buckets=4, path=str(tmp_path / "store"))
    kept = planner.planned(store, asked)
    assert exchanges(kept, "symbol") == 0 and exchanges(kept, "date") == 1
    assert sorted(map(tuple, d.collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)
    joined = store.join(store.groupBy("symbol").agg(F.max("date").alias("date")), ["symbol", "date"])
    assert exchanges(joined, "symbol") == 0 and joined.count() == 6


def test_planned_features_read_from_their_warmup_on(spark):
    bars, asked = some_bars(spark), ["sma_50", "return_21d", "excess_return_1"]
    whole = {(r.symbol, r.date): tuple(r) for r in planner.planned(bars, asked).collect()}
    part = planner.planned(bars, asked, start="2020-07-01", end="2020-07-20").collect()
    assert len(part) == 20 * 6 and all(whole[r.symbol, r.date] == tuple(r) for r in part) and planner.warmup_rows(asked) == 50


def test_cross_features_see_their_declared_past_only(spark):
    bars = some_bars(spark)
    last = F.lit(dt.date(2020, 10, 26))
    other = bars.withColumn("close", F.when(F.col("date") >= last, 999.0).otherwise(F.col("close")))
    a, b = (sorted(map(tuple, planner.planned(x, "relative").where(F.col("date") <= last).collect()), key=repr) for x in (bars, other))
    assert a == b
    with pytest.raises(ValueError, match="sma_21"):
        planner.planned(bars, ["sma_21"])
    with pytest.raises(ValueError, match="unknown feature set"):
        planner.planned(bars, "nonsense")
    with pytest.raises(ValueError, match="volume"):
        planner.planned(bars.drop("volume"), ["value_share"])
    for args, kw in ((("sma_20", ["close"]), {}), (("relative_price", ["close"]), {}), (("new", []), {}), (("new", ["close"]), {"lag": -1})):
        with pytest.raises(ValueError):
            planner.cross_feature(*args, **kw)
    assert set(planner.resolved("all")) >= set(planner.SETS["default"]) | set(planner.CROSS) and "new" not in planner.CROSS
