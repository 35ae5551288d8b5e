"""The sample filters in a session that has observed a query: such a session cannot be carried by tasks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import models as ml


@pytest.fixture
def rows(spark):
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    return spark.createDataFrame([("s", at(i), float(i % 7) - 3, float(i % 7 > 3)) for i in range(140)], "symbol string, bar timestamp_ntz, x double, label double")


def test_conformal_mask_after_an_observation(rows):
    kept = ml.conformal_mask(rows, ["x"], "label").collect()
    assert len(kept) == 140
    assert {r["keep"] for r in kept} == {0, 1}


def test_oob_mask_after_an_observation(rows):
    kept = ml.oob_mask(rows, ["x"], "label", 3).collect()
    assert len(kept) == 140
    assert {r["keep"] for r in kept} == {1}  # a split that a line can find has no errors


def few(rows, n):
    """``n`` rows of which none falls to validation."""
    return rows.where(ml.chance(1, "symbol", "bar", "label") >= 0.2).limit(n)


@pytest.mark.parametrize("n", [1, 3])
def test_train_without_validation_rows(rows, n):
    scored = ml.score(ml.train(few(rows, n), ["x"], "label", 2), rows, ["x"]).collect()
    assert len(scored) == 140 and all(0 <= r["p"] <= 1 for r in scored)


def test_no_rows_give_no_model_and_no_trades(rows, tmp_path):
    model = ml.stored(ml.train(rows.limit(0), ["x"], "label", 2), str(tmp_path))
    scored = ml.score(model, ml.score(model, rows, ["x"]), ["x"], "q").withColumn("open", F.lit(1.0))
    assert scored.where("p is null and q is null").count() == 140
    assert [r["n_trades"] for r in bt.trade_stats(bt.backtest(scored.select("symbol", "bar", "open", F.col("p").cast("double").alias("p"), F.col("q").cast("double").alias("q")), 0.5, 0.3)).collect()] in ([], [0])
