"""Small fixtures with known answers, and properties that must hold."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.functions import smooth as sm
from barloom.operators import backtest as bt
from barloom.operators import labels as lb
from barloom.operators import models as ml
from barloom.operators import regimes as rg
from barloom.operators import relational as rl
from barloom.sources import bars as src
from barloom.sources import sinks

T0 = dt.datetime(2024, 1, 1)


def series(spark, n=60, symbol="x", seed=1):
    rng = np.random.default_rng(seed)
    c = 100 + rng.normal(0, 1, n).cumsum()
    rows = [(symbol, T0 + dt.timedelta(hours=i), float(c[i] - 0.1), float(c[i] + 1), float(c[i] - 1), float(c[i]), 10 + i % 7) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, open double, high double, low double, close double, volume long")


def run(opens, p, thr, direction, q=None, most=1, delay=1):
    p, q = np.array(p), np.array(q or [1.0] * len(opens))
    buy = p > thr if direction == "buy" else 1 - p > thr if direction == "both" else np.zeros(len(p), bool)
    sell = p > thr if direction != "buy" else np.zeros(len(p), bool)
    trades, pos = bt.replay(np.array(opens, float), buy, sell, q > 0.5, most, delay)
    return [t[3] for t in trades], pos.tolist()


@pytest.mark.parametrize(
    ("opens", "p", "direction", "profits"),
    [([100, 103], [0.7, 0.4], "buy", [3]), ([100, 97], [0.7, 0.4], "sell", [3]), ([100, 98, 101, 99], [0.7, 0.2, 0.8, 0.3], "both", [2, 3, 2, 0])],
)
def test_backtest_fixtures(opens, p, direction, profits):
    assert run(opens, p, 0.6, direction)[0] == profits


def test_position_of_the_opening_bar_is_zero():
    assert run([100, 101, 102, 103, 104], [0.9, 0.9, 0.9, 0.1, 0.1], 0.6, "buy") == ([3], [0, 1, 1, 0, 0])


@pytest.mark.parametrize(
    ("n", "last", "high", "low", "first"),
    [(5, 2, {1: 1}, {}, 0.0), (5, 2, {1: 1}, {1: -1}, 2.0), (6, 3, {1: 1}, {2: -1}, 0.0)],
)
def test_first_touch(spark, n, last, high, low, first):
    rows = [("x", T0 + dt.timedelta(hours=i), 0.0, float(high.get(i, 0)), float(low.get(i, 0)), 1.0, i, n) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, close double, high double, low double, atr double, rn int, n int")
    got = [r.label for r in df.withColumn("label", lb.first_touch(df, 0.5, 1, last)).orderBy("bar").collect()]
    assert got[0] == first and got[-last:] == [2.0] * last


def test_features_do_not_look_ahead(spark):
    bars = series(spark, 40)
    changed = bars.withColumn("close", F.when(F.col("bar") >= F.lit(T0 + dt.timedelta(hours=30)).cast("timestamp_ntz"), 1.0).otherwise(F.col("close")))
    wanted = [(8, s, "main") for s in ft.STATISTICS]
    a, b = (ft.features(x, wanted).orderBy("bar").toPandas() for x in (bars, changed))
    names = [c for c in a.columns if c.endswith("_feature")]
    assert len(names) == 28
    pd.testing.assert_frame_equal(a.loc[:30, names], b.loc[:30, names])


def test_features_do_not_depend_on_partitions(spark):
    bars = series(spark, 50).union(series(spark, 50, "y", 2))
    wanted = [(6, "entropy", "main"), (9, "corrskew", "meta")]
    a, b = (sorted(map(repr, ft.features(x, wanted).select("symbol", "bar", "6_entropy_main_feature", "9_corrskew_meta_feature").collect())) for x in (bars, bars.repartition(7)))
    assert a == b


def test_unknown_statistic_and_short_window_raise(spark):
    with pytest.raises(ValueError):
        ft.features(series(spark, 5), [(8, "nothing", "main")])
    with pytest.raises(ValueError):
        ft.features(series(spark, 5), [(2, "std", "main")])


def test_savgol_keeps_a_cubic(spark):
    rows = [("x", T0 + dt.timedelta(hours=i), float(0.01 * i**3 - i)) for i in range(30)]
    df = sm.with_size(spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, close double"))
    got = df.select("close", sm.savgol("close", 8, 3, F.col("n"), F.col("rn")).alias("v")).toPandas()
    assert np.allclose(got.close, got.v)


def test_profits_sum_to_the_last_equity(spark):
    df = series(spark, 80).withColumn("p", F.pmod(F.hash("bar"), F.lit(100)) / 100.0).withColumn("q", F.lit(1.0))
    trades = bt.island_trades(df, 0.6, 0.5)
    general = bt.backtest(df, 0.6, 0.5)
    key = lambda d: sorted((r.trade_no, r.side, r.entry_bar, r.exit_bar, round(r.profit, 9)) for r in d.collect())
    assert key(trades) == key(general)
    last = bt.equity_curve(trades).orderBy(F.desc("point")).first().equity
    assert last == pytest.approx(trades.agg(F.sum("profit")).first()[0])


def test_overlapping_signals_need_the_general_backtest(spark):
    with pytest.raises(ValueError):
        bt.island_trades(series(spark, 5).withColumn("p", F.lit(0.5)).withColumn("q", F.lit(1.0)), 0.4, 0.5)


def test_history_reader(spark, tmp_path):
    f = tmp_path / "x_H1.csv"
    f.write_text("<DATE> <TIME> <OPEN> <HIGH> <LOW> <CLOSE> <TICKVOL>\n2024.01.01 00:00:00 1 2 0.5 1.5 7\n2024.01.01 01:00:00\t1 2 0.5 1.5 7\n2024.01.01 02:00:00 1 2 0.5 1.6 8\n2024.01.01 03:00:00 1 2 0.5\n")
    rows = sorted(map(tuple, src.read_history(spark, str(f), "x").collect()))
    assert rows == [("x", dt.datetime(2024, 1, 1, 0), 1.0, 2.0, 0.5, 1.5, 7), ("x", dt.datetime(2024, 1, 1, 2), 1.0, 2.0, 0.5, 1.6, 8)]


def test_sinks(spark, tmp_path):
    df = series(spark, 3).select("bar", "close", F.lit(None).cast("double").alias("5_std_main_feature"))
    sinks.write_dataset(df, str(tmp_path / "d"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "d")).collect()]
    assert "time,close,5_std_main_feature" in lines and any(x.startswith("2024.01.01 00:00:00,") for x in lines)
    d = sinks.descriptor("s", ["5_std_main_feature"], {"a": 1})
    assert '"period": 5' in d and d == sinks.descriptor("s", ["5_std_main_feature"], {"a": 1})
    sinks.append_trial(spark, str(tmp_path / "t"), {"a": "1"}, {"score": 0.5})
    assert spark.read.parquet(str(tmp_path / "t")).first().metrics == {"score": 0.5}


def test_parity_log(spark, tmp_path):
    text = "2024.01.01 00:00:00 [ 1 ] 1 2 3 4 5 6 7\n2024.01.01 00:00:00 [ 2 ] 8 9 10 11 12 13 14.5\nnoise 1 2\n"
    (tmp_path / "a.log").write_bytes(text.encode("utf-16"))
    row = sinks.read_parity_log(spark, str(tmp_path / "a.log")).first()
    assert row.n_groups == 2 and row.numbers == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14.5]


def test_trim_keeps_inner_gaps(spark):
    rows = [("x", T0 + dt.timedelta(hours=i), v) for i, v in enumerate([None, 1.0, None, float("inf"), 2.0, None])]
    df = spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, f double")
    assert rl.trim_warm_up(df, ["f"]).count() == 4


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 5):
        cost = rng.random((n, n))
        got = cost[np.arange(n), rg.assignment(cost)].sum()
        assert got == pytest.approx(min(cost[np.arange(n), list(p)].sum() for p in permutations(range(n))))


def test_inner_folds():
    assert ml.inner_folds(100, 5, 0.9) == 5 and ml.inner_folds(30, 5, 0.9) == 2 and ml.inner_folds(10, 5, 0.9) == 0


def test_density_clusters_are_refused(spark):
    with pytest.raises(NotImplementedError):
        rg.density(series(spark, 3), ["close"], 5)
