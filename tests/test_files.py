"""Reference tables in files."""

import datetime as dt

import pytest

from crossgrain.sources import files
from crossgrain.sources.bars import BAR, write_bars


def put(path, text):
    path.write_text(text)
    return str(path)


def test_tables_are_read_by_name_and_fail_loudly(spark, tmp_path):
    good = put(tmp_path / "m.csv", "Start_Date,symbol,index_name,end_date,note\n2024-01-01,a,x,,n\n2024-02-01,b,x,2024-03-01,\n")
    got = files.read_membership(spark, good).collect()
    assert [(r.symbol, r.start_date, r.end_date) for r in got] == [("a", dt.date(2024, 1, 1), None), ("b", dt.date(2024, 2, 1), dt.date(2024, 3, 1))]
    with pytest.raises(ValueError, match="report_date"):
        files.read_table(spark, good, files.FUNDAMENTALS)
    bad = put(tmp_path / "f.csv", "date,fii_net,dii_net\n2024-01-01,x,1\n")
    with pytest.raises(Exception):
        files.read_table(spark, bad, files.FLOWS).collect()


def test_sectors_take_the_last_line_of_a_symbol(spark, tmp_path):
    path = put(tmp_path / "s.csv", "Ticker,Industry\na,one\n,none\nb,\na,two\n")
    assert [tuple(r) for r in files.read_sectors(spark, path).collect()] == [("a", "two")]
    assert files.read_sectors(spark, None).count() == 0


def test_trial_log_skips_broken_lines(spark, tmp_path):
    path = str(tmp_path / "t")
    trial = spark.createDataFrame([("x", 1.5, "h", {"a": "1"}, {"m": 2.0}, "now")], files.TRIALS)
    files.log_trial(trial, path)
    files.log_trial(trial, path)
    (tmp_path / "t" / "broken.json").write_text("{not json\n")
    got = files.read_trials(spark, path).collect()
    assert len(got) == 2 and got[0].metrics == {"m": 2.0}


def test_outcomes_are_replaced_by_key(spark):
    row = lambda i, o, d: (i, "r", "s", "t", dt.date(2024, 1, d), 1.0, None, None, o, None, "q")
    a = spark.createDataFrame([row("1", "PENDING", 1), row("2", "PENDING", 2)], files.OUTCOMES)
    b = spark.createDataFrame([row("2", "WIN", 2), row("3", "PENDING", 3)], files.OUTCOMES)
    now = files.upserted(a, b, key="trade_id")
    assert sorted((r.trade_id, r.outcome) for r in now.collect()) == [("1", "PENDING"), ("2", "WIN"), ("3", "PENDING")]
    assert [r.trade_id for r in files.trade_history(now).collect()] == ["3", "2", "1"]
    assert sorted(r.trade_id for r in files.open_trades(now).collect()) == ["1", "3"]


def test_written_bars_are_ordered_and_whole(spark, tmp_path):
    rows = [("a", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0), ("a", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), ("a", dt.date(2024, 1, 3), None, None, None, None, None)]
    write_bars(spark.createDataFrame(rows, BAR), str(tmp_path / "b"), files=1)
    assert [r.date.day for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [1, 2]
