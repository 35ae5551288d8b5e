"""Labelers by name run with their defaults (short windows), refuse wrong parameters and stay within their classes."""

from __future__ import annotations

import numpy as np
import pytest

from barloom.operators import dispatch as dp
from barloom.operators import scoring as sc
from barloom.operators import stateful_labels as sl
from tests.test_units import series

SHORT = {
    "filter": {"rolling": 9}, "filter_binary": {"rolling": 9, "rolling2": 15}, "filter_multi": {"periods": (9, 15), "window": 20}, "fractal": {"longest": 12}, "trend": {"rolling": 9, "vol_window": 10},
    "trend_multi": {"periods": (7, 9), "vol_window": 10}, "trend_filters": {"kind": "ema", "rolling": 9, "vol_window": 10}, "clusters": {"n_clusters": 4}, "multi_window": {"windows": (5, 10)},
    "mean_rev": {"kind": "mean", "rolling": 9, "shift": 2}, "mean_rev_vol": {"rolling": 9},
}


@pytest.mark.parametrize("method", sorted(dp.LABELERS))
def test_labelers(spark, method):
    bars = series(spark, 90)
    got = dp.label(bars, method, **SHORT.get(method, {}))
    assert got.columns == [*bars.columns, "label"]
    values = [r.label for r in got.collect()]
    assert len(values) == 90 and set(values) <= {0.0, 1.0, 2.0}


def test_wrong_names_raise(spark):
    bars = series(spark, 5)
    with pytest.raises(ValueError):
        dp.label(bars, "nothing")
    with pytest.raises(ValueError):
        dp.label(bars, "random", window=3)
    with pytest.raises(ValueError):
        dp.label(bars, "filter", kind="spline")


def test_prominence():
    x = np.array([0, 2, 1, 3, 3, 0, 1, 0.9, 1.2, 0], float)
    assert np.flatnonzero(sl.extremes(x, 0.5)).tolist() == [1, 3, 8]
    assert np.flatnonzero(sl.extremes(x, 0.05)).tolist() == [1, 3, 6, 8]


def test_periods_per_year():
    assert sc.periods_per_year("H1") == 22 * 5 * 252 == sc.periods_per_year("?") and sc.periods_per_year("D1") == 5 * 252
