"""Tables of larger keys, and whole jobs where a cut had crept in."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.operators import allocation, books, boosting, exposures, gram, grouped, market, metrics, studies
from crossgrain.plans import registry
from crossgrain.plans import studies as studies_queries
from crossgrain.sources.bars import bars

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def shifted(spark, sf, tmp_path_factory):
    """The trades with suppliers from 50,000 on: their number times a million is no 32-bit integer."""
    at = str(tmp_path_factory.mktemp("shifted"))
    spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_suppkey", (F.col("l_suppkey") + 50_000).cast("bigint")).write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("name", ["V1_price_order", "V2_positive_prices", "V3_duplicate_dates", "V4_unsorted_input", "V11_ingest_gate", "G36_quality_report", "P3_clean_rows", "S2_ingest_gate"])
def test_large_symbols_do_not_overflow(spark, shifted, name):
    assert QUERIES[name](spark, shifted).count() > 0


@pytest.mark.parametrize("name", ["V1_price_order", "V2_positive_prices", "V3_duplicate_dates", "V4_unsorted_input", "V11_ingest_gate", "G36_quality_report", "P3_clean_rows", "S2_ingest_gate"])
def test_large_symbols_have_the_results_of_64_bits(spark, shifted, name):
    """The SQL stops on these tables, as its sequence has 32 bits; here its cast, and nothing else, is widened."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{shifted}/lineitem.parquet/*.parquet')")
    sql = registry.oracle_sql()[name]
    with pytest.raises(duckdb.OutOfRangeException):
        con.sql(f"SELECT count(*) FROM ({sql})").fetchall()
    rel = con.sql(sql.replace("CAST(symbol AS INTEGER)", "CAST(symbol AS BIGINT)"))
    want = sorted(map(repr, rel.fetchall()))
    assert want and sorted(repr(tuple(r)) for r in QUERIES[name](spark, shifted).select(*rel.columns).collect()) == want


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("name", ["P3_clean_rows", "V1_price_order", "V2_positive_prices"])
def test_checks_read_the_trades_once(spark, sf, name):
    """The bars were made once more for the rows that are there twice, and the checks of single rows each read them anew."""
    assert scans(QUERIES[name](spark, sf)) == 1


def test_a_batch_waits_until_it_arrives_and_no_longer(spark, tmp_path, monkeypatch):
    """All batches lay on disk once more until the last one had arrived."""
    monkeypatch.setattr(studies_queries.files, "scratch", lambda spark, name: str(tmp_path / name))
    rows = spark.range(12).select("id", (F.col("id") % 3 - 1).cast("int").alias("arrival"))
    seen = []

    class Run:
        def __init__(self, stream, checkpoint):
            self.stream = stream

        def awaitTermination(self):
            here = {r.id for r in spark.read.schema("id long").parquet(str(tmp_path / "x")).collect()}
            left = {r.id for r in spark.read.schema("id long, arrival int").parquet(str(tmp_path / "x-waiting")).collect()}
            seen.append((here, left, self.stream.columns))

    studies_queries.arriving(rows, "arrival", Run, "x")
    part = lambda *numbers: {k for k in range(12) if k % 3 - 1 in numbers}
    assert seen == [(part(-1), part(0, 1), ["id"]), (part(-1, 0), part(1), ["id"]), (part(-1, 0, 1), set(), ["id"])]


def test_exemption_has_a_lot_for_every_bar_held_a_year(spark, sf):
    rows = {}
    for r in bars(spark, sf).select("symbol", "date").orderBy("symbol", "date").collect():
        rows.setdefault(r.symbol, []).append(r.date)
    lots = {(s, a) for s, d in rows.items() for a, b in zip(d, d[60:]) if (b - a).days >= 365}
    got = QUERIES["W22_running_exemption"](spark, sf).collect()
    assert {(r.symbol, r.date) for r in got} == lots and len(got) == len(lots)
    assert len({r.date.month for r in got}) == 12


def test_tradability_screens_every_weekly_bar(spark, sf):
    assert QUERIES["P6_tradability"](spark, sf).count() == bars(spark, sf).count()


def test_many_symbols_are_copied_few_times(spark):
    """A symbol is shuffled once for each block, so that blocks have to grow with the symbols."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("symbol"))
    cells = gram._cells(rows, gram.BLOCK)
    assert cells.count() <= 8 * rows.count()
    assert cells.groupBy("low", "high").count().count() == 36


def test_cells_are_not_put_together_by_size(spark):
    """A few small cells were merged into one task, which then answered for all pairs."""
    returns = holed(spark, 20)
    assert gram.covariance(returns, 4).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def holed(spark, symbols: int, dates: int = 30):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(dates, symbols)) + 3
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, ::3] = rng.normal(size=(dates, len(range(0, symbols, 3))))  # many whole ones, which share their dates
    x[1:, 1], x[:-1, 2] = np.nan, np.nan  # one date each, not the same
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(d), f"s{j}", float(x[d, j])) for d in range(dates) for j in range(symbols) if not np.isnan(x[d, j])]
    return spark.createDataFrame(rows, "date date, symbol string, ret double")


@pytest.mark.parametrize("block", [4, 256])
def test_risk_of_a_book_without_its_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(gram, "TILE", 20)
    returns = holed(spark, 20)
    weights = spark.createDataFrame([(f"s{j}", 0.5 + j / 7) for j in range(20)], "symbol string, weight double")
    want = books.book_risk(weights, gram.covariance(returns, block)).first()
    got = books.risk_of_returns(weights, returns).first()
    assert list(got) == pytest.approx(list(want), rel=1e-9)
    pairs = gram.covariance(returns, block).collect()
    dates = {r.symbol: set(r.d) for r in returns.groupBy("symbol").agg(F.collect_list("date").alias("d")).collect()}
    assert sorted((r.i, r.j) for r in pairs) == sorted((i, j) for i in dates for j in dates if dates[i] & dates[j])


def written_bytes(df, at):
    df.write.parquet(str(at))
    return sum(f.stat().st_size for f in at.iterdir()) / df.count()


def walking(spark, copies: int):
    """480 symbols of 480 / copies different series."""
    x = np.repeat(np.random.default_rng(7).normal(size=(480 // copies, 12)), copies, 0)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(d), f"s{(j * 77) % 480}", float(x[j, d])) for j in range(480) for d in range(12)]
    return spark.createDataFrame(rows, "date date, symbol string, ret double")


def test_mirrored_covariances_lie_side_by_side(spark, tmp_path):
    """A tile's pairs were mirrored behind the tile, too far for a file to hold a number once."""
    assert written_bytes(gram.covariance(walking(spark, 1)), tmp_path / "own") < 7.5
    assert written_bytes(gram.covariance(walking(spark, 8)), tmp_path / "alike") < 1.5


@pytest.mark.parametrize("block", [4, 256])
def test_single_factor_has_every_pair_once(spark, block):
    be = {f"s{j}": (None if j == 3 else j / 3, None if j == 4 else j - 5.0) for j in range(12)}
    rows = spark.createDataFrame([(s, b, o, 0.25) for s, (b, o) in be.items()], "symbol string, beta double, own double, v double")
    got = gram.single_factor(rows, block).collect()
    want = {(i, j): None if None in (be[i][0], be[j][0]) else be[i][0] * be[j][0] * 0.25 + (max(be[i][1] or 0, 0) if i == j else 0) for i in be for j in be}
    assert len(got) == 144 and all(r.cov == (None if want[r.i, r.j] is None else pytest.approx(want[r.i, r.j])) for r in got)


def test_binomial_tail_of_many_trades(spark):
    """A term was worked out from nothing, so that time grew with the square of the trades."""
    cases = [(1, 1), (1, 2), (7, 7), (6, 10), (30, 50), (520, 1000), (100_300, 200_000), (1_000_700, 2_000_000)]
    rows = spark.createDataFrame(cases, "wins long, total long")
    got = {(r.wins, r.total): r.p for r in rows.select("wins", "total", allocation.binomial_tail(F.col("wins"), F.col("total")).alias("p")).collect()}
    for wins, total in cases:
        want = sum(math.exp(math.lgamma(total + 1) - math.lgamma(j + 1) - math.lgamma(total - j + 1) - total * math.log(2)) for j in range(wins, total + 1))
        assert got[wins, total] == pytest.approx(min(1.0, want), rel=1e-6)


@pytest.mark.parametrize("block", [4, 256])
def test_nearest_pairs_are_those_of_all_tests(spark, block, monkeypatch):
    monkeypatch.setattr(market, "TILE", 30)
    rng = np.random.default_rng(3)
    p = rng.normal(size=(40, 20)).cumsum(0) / 10
    p[:, 7] = p[:, 5]  # a spread that does not move, and pairs of equal statistics
    rows = [(f"s{j}", dt.date(2020, 1, 1) + dt.timedelta(d), float(np.exp(p[d, j]))) for d in range(40) for j in range(20)]
    prices = spark.createDataFrame(rows, "symbol string, date date, close double")
    every = market.pair_tests(prices, block)
    assert every.count() == 190 == every.select("a", "b").distinct().count() and every.where("a >= b").count() == 0
    want = [(r.a, r.b) for r in studies.nearest_pairs(every, 9).collect()]
    few = market.pair_tests(prices, block, nearest=9)
    assert few.count() <= 9 * 15 and [(r.a, r.b) for r in studies.nearest_pairs(few, 9).collect()] == want
    known = {(r.a, r.b): (r.t, r.p_value) for r in every.collect()}
    assert all((r.t, r.p_value) == pytest.approx(known[r.a, r.b]) for r in few.collect())


def held(spark, names: int, rows: int = 12):
    """Two dates: one of many names, some of them the same but for the name, and one of a single name."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(names, rows)) * rng.uniform(0.5, 2, (names, 1)) + rng.normal(size=rows)
    x[names // 2 : names // 2 + 5] = x[:5]
    data = [(1, f"s{k}", x[k].tolist()) for k in range(names)] + [(2, "s0", x[0].tolist())]
    return x, spark.createDataFrame(data, "date int, symbol string, returns array<double>")


def test_book_of_a_date_needs_no_pairs(spark, monkeypatch):
    """All pairs of a book were made, joined and summed for what sums over names give."""
    monkeypatch.setattr(grouped, "moments_of_pairs", None, raising=False)
    x, windows = held(spark, 60)
    got = {r.date: r for r in grouped.book_volatility(windows).collect()}
    want = {r.date: r for r in studies.book_risks(grouped.shrunk_covariance(windows)).collect()}
    assert {d: r.names for d, r in got.items()} == {1: 60, 2: 1} and all(got[d].volatility == pytest.approx(want[d].volatility) for d in (1, 2))
    cov = np.zeros((60, 60))
    for row in grouped.shrunk_covariance(windows).where("date = 1").collect():
        i, j = int(row.i[1:]), int(row.j[1:])
        cov[i, j] = cov[j, i] = row["cov"]
    order = sorted(range(60), key=lambda k: f"s{k}")
    weights = {r.symbol: r.weight for r in grouped.hierarchical_book(windows).where("date = 1").collect()}
    assert [weights[f"s{k}"] for k in order] == pytest.approx(grouped.hierarchical_weights(cov[np.ix_(order, order)]))


def test_shrunk_pairs_in_blocks_and_tiles(spark, monkeypatch):
    x, windows = held(spark, 40)
    want = {(r.date, r.i, r.j): (r["cov"], r.share) for r in grouped.shrunk_covariance(windows).collect()}
    assert len(want) == 40 * 41 // 2 + 1 and all(i <= j for _, i, j in want) and 0 < want[1, "s0", "s1"][1] < 1
    cells = grouped._covariances  # tasks run in processes of their own
    monkeypatch.setattr(grouped, "BLOCK", 7)
    got = grouped.shrunk_covariance(windows).collect()
    assert len(got) == len(want) and {(r.date, r.i, r.j): (r["cov"], r.share) for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    monkeypatch.setattr(grouped, "TILE", 30)
    d = grouped.centred(windows).join(grouped.best_share(grouped.centred(windows)), "date").where("date = 1").withColumns({"low": F.lit(0), "high": F.lit(0), "own": F.lit(0)})
    parts = list(cells(iter(d.toArrow().to_batches())))
    assert len(parts) == 40 and sum(p.num_rows for p in parts) == 40 * 39 // 2


def test_composite_names_each_window_once(spark):
    """A rank was written out wherever the normal quantile names it, and the windows were carried along in as many columns."""
    rows = spark.createDataFrame([(1, "a", 0.5, 2.0), (1, "b", None, 3.0), (1, "c", 0.7, 3.0)], "date int, symbol string, x double, y double")
    plan = grouped.probit_composite(rows, {"x": 2.0, "y": 1.0})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rank(") <= 4 and len(plan) < 60_000


@pytest.mark.parametrize("slices", [1, 8, 1 << 16])
def test_quantiles_of_rank_errors_in_slices(spark, slices):
    """One task gathered every distinct error of a bucket, and one those of all."""
    rng = np.random.default_rng(9)
    data = [(int(k % 3), float(np.round(e, 2) if k % 2 else e)) for k, e in enumerate(rng.uniform(-1, 1, 400))] + [(4, 0.25)] + [(5, -0.5)] * 40
    rows = spark.createDataFrame(data, "bucket long, e double")
    got = {(r.bucket, r.q): r.value for r in metrics.spread_quantiles(rows, [0.05, 0.5, 0.95], slices).collect()}
    want = {(b, q): np.quantile([e for g, e in data if b in (None, g)], q) for b in (None, 0, 1, 2, 4, 5) for q in (0.05, 0.5, 0.95)}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_lagged_tests_take_one_elimination_a_pair(spark, monkeypatch):
    """Each lag's regression of each pair was solved by a pseudo-inverse of its own, and all pairs were tested three times."""
    rng = np.random.default_rng(13)
    spreads = rng.normal(size=(60, 84)).cumsum(1)
    spreads[30:] = rng.normal(size=(30, 84)) + 5
    want = market._solved(spreads, 11)
    tests = market.pair_tests(spark.createDataFrame([(f"s{j}", dt.date(2020, 1, 1) + dt.timedelta(d), float(np.exp(spreads[j, d] / 10))) for j in range(12) for d in range(84 - (j == 3))], "symbol string, date date, close double"), lags=None)
    assert tests.count() == 55
    monkeypatch.setattr(market, "_solved", lambda rows, most: (np.full(len(rows), np.nan), np.full(len(rows), -1)))
    t, lags = market.augmented(spreads, 11)
    assert t == pytest.approx(want[0], rel=1e-9) and (lags == want[1]).all() and len(set(lags)) > 3
    assert (market.augmented(np.tile([2.0], (3, 84)), 11)[1] == -1).all()  # what is not determined goes the plain way


def test_selection_is_told_the_number_of_pairs(spark, sf):
    b = bars(spark, sf, "month")
    tests = market.pair_tests(b)
    assert market.tested_pairs(b).first().pairs == tests.count() > 0
    known = spark.createDataFrame([(1,)], "pairs long")  # as if one pair had been tested: the level is wider
    assert market.selected_pairs(tests, tested=market.tested_pairs(b)).where("selected").count() == market.selected_pairs(tests).where("selected").count() <= market.selected_pairs(tests, tested=known).where("selected").count()


def test_caps_are_found_by_running_sums(spark):
    """A frame from each row to its date's end was summed anew for each row: the square of a date's names."""
    weights = spark.range(40).select(F.lit(1).alias("date"), F.col("id").cast("string").alias("symbol"), ((F.col("id") % 7 + 1) / 157.0).alias("weight"))
    d = allocation.capped(weights, 0.04)
    assert "unboundedfollowing$()" not in d._jdf.queryExecution().optimizedPlan().toString().replace("unboundedpreceding$(), unboundedfollowing$()", "")
    got = [r.weight for r in d.collect()]
    assert max(got) == pytest.approx(0.04) and sum(got) == pytest.approx(1)


def test_exposures_are_fitted_without_ordering_the_panel(spark):
    """Windows over dates and groups put the whole panel in order, three times."""
    rng = np.random.default_rng(17)
    rows = [(d, f"s{k}", f"g{k % 3}", *map(float, rng.normal(size=3))) for d in range(3) for k in range(30)]
    panel = spark.createDataFrame(rows, "date int, symbol string, sector string, score double, x double, z double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("date")))
    d = exposures.neutralized(panel, ["x", "z"], group="sector")
    assert "Window" not in d._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.date, r.symbol): r.residual for r in d.collect()}
    assert len(got) == 90
    for date in {k[0] for k in got}:
        own = [r for r in panel.collect() if r.date == date]
        a = np.array([[r.x, r.z, *(r.sector == g for g in ("g0", "g1", "g2"))] for r in own], float)
        y = np.array([r.score for r in own])
        assert [got[date, r.symbol] for r in own] == pytest.approx(y - a @ np.linalg.lstsq(a, y, rcond=None)[0], abs=1e-9)


def test_market_of_the_bars_is_that_of_the_grid(spark, sf):
    """The grid was made twice, once for the market alone."""
    b = bars(spark, sf, "week")
    got = market.with_market(b)
    want = {r.date: r.m for r in got.where("r is not null").groupBy("date").agg(F.avg("r").alias("m")).collect()}
    assert {r.date: r.m for r in got.select("date", "m").distinct().collect() if r.m is not None} == {k: pytest.approx(v) for k, v in want.items()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Cross") + got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner\n") <= 1


def test_correlations_from_placed_labels(spark):
    """Labels were ranked anew for each setting and each round, and every row's score put in order."""
    rng = np.random.default_rng(19)
    rows = [(k, d, f"s{i}", float(np.round(s, 1)) if d else 1.0, float(np.round(y, 1))) for k in range(2) for d in range(4) for i, (s, y) in enumerate(rng.normal(size=(4 if d == 3 else 25, 2)))]
    d = spark.createDataFrame(rows, "k int, date int, symbol string, score double, label double")
    d = metrics.placed(d.where("k = 0"), "label").unionByName(metrics.placed(d.where("k = 1"), "label"))
    want = {(r.k, r.date): (r.ic, r.names) for r in metrics.rank_ic(d, "k", "date", label="label").collect()}
    got = {(r.k, r.date): (r.ic, r.names) for r in metrics.place_ic(d, "k", "date").collect()}
    assert len(want) == 4 and got == {k: pytest.approx(v) for k, v in want.items()}
    both = {r.date: (r.ic_score, r.ic_label) for r in metrics.rank_ics(d.where("k = 0"), ("score", "label"), label="label").collect()}
    assert both == {dt_: (pytest.approx(want[0, dt_][0]), pytest.approx(1.0)) for dt_ in (1, 2)}


def test_gradients_put_no_rows_in_order(spark):
    rows = [(d, f"s{i}", float(i % 4) * d, float((i * 7) % 10)) for d in range(2) for i in range(10)]
    d = spark.createDataFrame(rows, "date int, symbol string, score double, target double")
    got = boosting.ascent(d)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.date, r.symbol): r.gradient for r in studies.ic_gradient(d, label="target").collect()}
    assert all(r.gradient == pytest.approx(want[r.date, r.symbol]) for r in got.collect() if r.date == 1)
    assert all(want[0, f"s{i}"] is None for i in range(10)) and all(r.gradient == pytest.approx((r.target - 4.5) / 82.5**0.5) for r in got.collect() if r.date == 0)


def test_pairs_that_cannot_be_nearest_are_not_tested(spark):
    """Every pair's statistic was worked out in 64 bits to keep a few; now sums of 32 bits tell which may be among them, and none is lost."""
    rng = np.random.default_rng(23)
    x = 7 + rng.normal(size=(300, 40)) * rng.uniform(0.01, 2, (300, 1))
    x[150:160] = x[:10] + rng.normal(size=(10, 40)) * 1e-5  # spreads of which 32 bits know nothing
    panel = market._Panel(x)
    a, b = np.arange(150), np.arange(150, 300)
    t = panel.tested(a, b, np.ones((150, 150), bool))[1]
    for cut in np.quantile(t, [0.001, 0.01, 0.5]):
        found = set(zip(*panel.below(a, b, float(cut))))
        assert found >= set(zip(*np.nonzero(t <= cut))) and len(found) <= (t <= cut + 0.01).sum() + 150
    assert panel.alone(np.arange(150), np.arange(150, 300))[1] == pytest.approx(np.diag(t))


def test_cells_of_pairs_are_not_put_together_by_size(spark, sf):
    tests = market.pair_tests(bars(spark, sf, "month"), nearest=9)
    assert tests.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


@pytest.mark.parametrize("nearest", [None, 40])
def test_spreads_of_equal_prices_do_not_move(spark, nearest):
    """Sums of products left a rounding error, of which a deviation and a statistic were made, even one among the nearest."""
    x = 7 + np.random.default_rng(29).normal(size=(9, 60)) / 4
    rows = [(f"s{j}", dt.date(2020, 1, 1) + dt.timedelta(d), float(np.exp(x[j % 9, d]))) for j in range(72) for d in range(60)]
    tests = market.pair_tests(spark.createDataFrame(rows, "symbol string, date date, close double"), nearest=nearest).collect()
    same = [r for r in tests if int(r.a[1:]) % 9 == int(r.b[1:]) % 9]
    assert len(tests) == (72 * 71 // 2 if nearest is None else 40) and len(same) == (9 * 28 if nearest is None else 0)
    assert all((r.hedge, r.t, r.spread_mean, r.spread_std) == (1, None, 0, 0) for r in same)


def test_pairs_of_equal_prices_lie_side_by_side(spark, tmp_path):
    x = np.repeat(7 + np.random.default_rng(31).normal(size=(30, 40)) / 4, 16, 0)
    rows = [(f"s{(j * 77) % 480}", dt.date(2020, 1, 1) + dt.timedelta(d), float(np.exp(x[j, d]))) for j in range(480) for d in range(40)]
    tests = market.pair_tests(spark.createDataFrame(rows, "symbol string, date date, close double")).drop("p_value", "lags")
    assert written_bytes(tests, tmp_path / "alike") < 5


def test_lagged_tests_of_a_tile_are_those_of_its_spreads(spark, sf):
    """Each spread was made, and the products of its changes summed, twice for each pair: once to select, once to answer."""
    rng = np.random.default_rng(37)
    x = 7 + rng.normal(size=(60, 84)) / 4
    x[::4] = 7 + rng.normal(size=(15, 84)).cumsum(1) / 20
    x[40:44], x[44:48] = x[:4], x[:4] + rng.normal(size=(4, 84)) * 1e-5
    panel, a, b = market._Panel(x), np.arange(30), np.arange(30, 60)
    up = rng.random((30, 30)) < 0.5
    found = panel.tested(a, b, up)
    t, lags = panel.lagged(a, b, up, found, 11)
    own, other = np.where(up, a[:, None], b).ravel(), np.where(up, b, a[:, None]).ravel()
    want = market.augmented(x[own] - found[0].ravel()[:, None] * x[other], 11)
    moves = (found[3] > 0).ravel()
    assert moves.sum() == 896 and np.isnan(t.ravel()[~moves]).all() and len(set(want[1])) > 5
    assert t.ravel()[moves] == pytest.approx(want[0][moves], rel=1e-6) and (lags.ravel() == want[1])[moves].all()
    prices = bars(spark, sf, "month")
    tests, few = market.pair_tests(prices, lags=3), market.pair_tests(prices, lags=3, nearest=7, digits=None)
    pick = lambda d: {(r.a, r.b) for r in d.where("selected").collect()}
    assert len(pick(market.selected_pairs(tests, most=7, tested=market.tested_pairs(prices)))) == 7
    assert pick(market.selected_pairs(tests, most=7, tested=market.tested_pairs(prices), nearest=few)) == pick(market.selected_pairs(tests, most=7))


def test_rolling_pairs_make_the_bars_once(spark, sf):
    """The bars were made anew from the trades for the folds, their dates and both legs."""
    assert "l_shipdate" not in QUERIES["M4_rolling_cheapness"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
