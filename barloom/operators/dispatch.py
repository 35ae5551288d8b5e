"""Labelers by name, with checked parameters, and the labelled data set that models are fitted on."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.functions import smooth as sm
from barloom.functions.frames import incl
from barloom.operators import labels as lb
from barloom.operators import relational as rl
from barloom.operators import stateful_labels as sl


def _curve(df: DataFrame, kind: str, rolling: int, polyorder: int, name: str = "curve") -> DataFrame:
    """A smoothed close: savgol, mean (sma), or ema."""
    if kind == "savgol":
        return df.withColumn(name, sm.savgol("close", rolling, polyorder, F.col("n"), F.col("rn")))
    if kind in ("mean", "sma"):
        return df.withColumn(name, sm.sma("close", rolling))
    if kind == "ema":
        return sm.ema(df, rolling, "close", name)
    raise ValueError(f"unknown curve {kind}; a smoothing spline is not offered")


def _quantile_bounds(df: DataFrame, low: float, high: float, *keys: str) -> DataFrame:
    return df.join(df.groupBy("symbol", *keys).agg(F.percentile("lvl", low).alias("lo"), F.percentile("lvl", high).alias("hi")), ["symbol", *keys])


def _random(df, markup=0.5, max_val=5, direction="both"):
    return df.withColumn("label", lb.random(markup, max_val, direction))


def _filter(df, markup=0.5, max_val=15, direction="both", kind="savgol", rolling=200, polyorder=3, decay=0.95, inverse=False, shift=0, low=0.45, high=0.55):
    df = _curve(df, kind, rolling, polyorder)
    if shift:
        rolled = df.select("symbol", F.pmod(F.col("rn") + shift, F.col("n")).alias("rn"), F.col("curve").alias("rolled"))
        df = df.join(rolled, ["symbol", "rn"]).withColumn("curve", F.col("rolled")).drop("rolled")
    weight = F.exp(F.col("rn") * decay / F.col("n"))
    gap = F.col("close") - F.col("curve")
    df = df.withColumn("lvl", F.try_divide(F.lit(1.0), gap * weight) if inverse else gap * weight)
    return _quantile_bounds(df, low, high).withColumn("label", lb.deviation(F.col("lvl"), F.col("lo"), F.col("hi"), markup, max_val, direction))


def _filter_binary(df, markup=0.5, max_val=15, direction="both", rolling=200, rolling2=200, polyorder=3, low=0.45, high=0.55):
    df = _curve(_curve(df, "savgol", rolling, polyorder, "one"), "savgol", rolling2, polyorder, "two")
    df = df.withColumns({"a": F.col("close") - F.col("one"), "b": F.col("close") - F.col("two")})
    df = df.join(df.groupBy("symbol").agg(F.percentile("a", high).alias("hi"), F.percentile("b", low).alias("lo")), "symbol")
    gain, fall = F.col("fwd") - markup * F.col("atr") > F.col("close"), F.col("fwd") + markup * F.col("atr") < F.col("close")
    zone = lb.zones(F.col("b") < F.col("lo"), F.col("a") > F.col("hi"), gain, fall, direction)
    return df.withColumn("label", F.when(F.col("rn") < F.col("n") - max_val, zone).otherwise(2.0))


def _filter_multi(df, markup=0.5, max_val=15, direction="both", periods=(200, 400, 600), window=100, polyorder=3, low=0.45, high=0.55):
    bounds = []
    for k in periods:
        df = _curve(df, "savgol", k, polyorder, f"c{k}").withColumn(f"l{k}", F.col("close") - F.col(f"c{k}"))
        bounds.append((F.col(f"l{k}"), F.percentile(f"l{k}", low).over(incl(window)), F.percentile(f"l{k}", high).over(incl(window))))
    return df.withColumn("label", F.coalesce(lb.consensus(bounds, markup, max_val, direction), F.lit(2.0)))


def _strength(df, name, vol_window):
    return F.try_divide(sm.gradient(name), sm.rolling_std(name, vol_window))


def _trend(df, markup=0.5, max_val=15, direction="both", kind="savgol", rolling=200, polyorder=3, threshold=0.5, vol_window=50):
    df = _curve(df, kind, rolling, polyorder)
    return df.withColumn("strength", _strength(df, "curve", vol_window)).withColumn("label", lb.trend(F.col("strength"), threshold, markup, max_val, direction))


def _trend_multi(df, markup=0.5, max_val=15, direction="both", kind="savgol", periods=(10, 20, 30), polyorder=3, threshold=0.5, vol_window=50):
    for k in periods:
        df = _curve(df, kind, k, polyorder, f"c{k}")
        df = df.withColumn(f"s{k}", _strength(df, f"c{k}", vol_window))
    return df.withColumn("label", lb.trend_multi([F.coalesce(f"s{k}", F.lit(0.0)) for k in periods], threshold, markup, max_val, direction))


def _multi_window(df, markup=0.5, max_val=15, direction="both", windows=(20, 50, 100)):
    return df.withColumn("label", lb.multi_window(list(windows), markup, max_val, direction))


def _mean_rev_vol(df, markup=0.5, max_val=15, direction="both", kind="mean", rolling=20, polyorder=3, vol_window=20, low=0.45, high=0.55):
    df = _curve(df, kind, rolling, polyorder).withColumns({"vol": sm.rolling_std("close", vol_window)}).withColumn("lvl", F.col("close") - F.col("curve"))
    df = df.join(sm.quantile_bins(df, "vol"), "symbol").withColumn("bin", sm.bin_of(F.col("vol"), F.col("edges")))
    return _quantile_bounds(df, low, high, "bin").withColumn("label", lb.deviation(F.col("lvl"), F.col("lo"), F.col("hi"), markup, max_val, direction))


def _mean_rev_multi(df, markup=0.5, max_val=15, direction="both", kind="mean", windows=(10, 20, 40), polyorder=3, low=0.3, high=0.7):
    """At least two curves at or beyond their quantiles."""
    below, above = F.lit(0), F.lit(0)
    for k in windows:
        df = _curve(df, kind, k, polyorder, f"c{k}").withColumn("lvl", F.col("close") - F.col(f"c{k}"))
        df = _quantile_bounds(df, low, high).withColumnsRenamed({"lvl": f"l{k}", "lo": f"lo{k}", "hi": f"hi{k}"})
        below = below + F.when(F.col(f"l{k}") <= F.col(f"lo{k}"), 1).otherwise(0)
        above = above + F.when(F.col(f"l{k}") >= F.col(f"hi{k}"), 1).otherwise(0)
    zone = lb.zones(below >= 2, above >= 2, lb.up(markup, True), lb.down(markup, True), direction)
    return df.withColumn("label", F.when(F.col("rn") < F.col("n") - max_val, zone).otherwise(2.0))


def _fractal(df, markup=0.5, max_val=5, direction="both", shortest=6, longest=60, threshold=0.7):
    return sl.fractal(df, shortest, longest, threshold, markup, max_val, direction)


def _clusters(df, markup=0.5, max_val=0, n_clusters=20, seed=1):
    """Clusters of close by one-dimensional k-means of all rows; jumps between them."""
    from barloom.operators.regimes import kmeans

    return sl.cluster_jumps(kmeans(df, ["close"], n_clusters, seed), "regime", markup)


def _levels(df, markup=0.5, max_val=15, direction="both", window=20, min_touches=2):
    return sl.validated_levels(df, window, min_touches, markup, max_val, direction)


def _zigzag(df, markup=0.5, max_val=15, direction="both", prominence=0.1):
    return lb.label_zigzag(sl.prominent_extremes(df, prominence), markup, max_val, direction)


def _first_touch(df, markup=0.5, max_val=15, min_val=1):
    return df.withColumn("label", lb.first_touch(df, markup, min_val, max_val))


LABELERS: dict[str, Callable[..., DataFrame]] = {
    "random": _random,
    "filter": _filter,
    "filter_binary": _filter_binary,
    "filter_multi": _filter_multi,
    "fractal": _fractal,
    "trend": _trend,
    "trend_multi": _trend_multi,
    "trend_filters": _trend,
    "clusters": _clusters,
    "multi_window": _multi_window,
    "validated_levels": _levels,
    "zigzag": _zigzag,
    "mean_rev": _filter,
    "mean_rev_multi": _mean_rev_multi,
    "mean_rev_vol": _mean_rev_vol,
    "first_touch": _first_touch,
}


def label(bars: DataFrame, method: str, min_val: int = 1, atr_period: int = 14, **params) -> DataFrame:
    """``bars`` (with whatever other columns) and ``label`` by one of ``LABELERS``; wrong names raise and nothing is clamped."""
    if method not in LABELERS:
        raise ValueError(f"unknown method {method}; one of {sorted(LABELERS)}")
    known = inspect.signature(LABELERS[method]).parameters
    wrong = set(params) - set(known)
    if wrong:
        raise ValueError(f"{method} has no parameter {sorted(wrong)}")
    horizon = max(params.get("max_val", known["max_val"].default), min_val)
    ready = lb.prepared(bars, min_val, horizon, atr_period)
    return LABELERS[method](ready, **params).select(*bars.columns, "label")


def labelled_data(bars: DataFrame, wanted: list[tuple[int, str, str]], method: str, params: dict, train: tuple[str, str], test: tuple[str, str], precision: int = 6) -> DataFrame:
    """Features, label and split of the bars from the earlier start on: context is padded by the longest windows, warm-up rows are
    trimmed and unstable columns dropped. Raises if the training or the test part is empty."""
    pad = sum(max((p for p, _, r in wanted if r == role), default=0) for role in ("main", "meta"))
    context = rl.padded(bars, min(train[0], test[0]), pad)
    features = ft.rounded(ft.features(context, wanted), precision).drop("rn", "r", "d")
    names = [c for c in features.columns if c.endswith("_feature")]
    data = rl.trim_warm_up(label(features, method, **params), names)
    data = rl.drop_unstable(data, names).withColumn("split", rl.split(F.col("bar"), train, test))
    sizes = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    if not sizes.get("IS") or not sizes.get("OOS"):
        raise ValueError(f"an empty split: {sizes}")
    return data
