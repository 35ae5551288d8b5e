"""The 28 rolling statistics, each over the p rows before the current one (no look-ahead).

Return statistics read log returns and exist from row p + 1 on, price statistics from row p. A cell without a value is null.
Statistics with a window aggregate stay in one window node; the others read one collected frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import ordered, trail, with_base

ON_RETURNS = ("std", "mean", "median", "iqr", "mad", "sharpe", "autocorr")


def _div(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and ``empty`` where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, F.lit(empty)))


def _array_mean(x: Column, n: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n


def _array_std(x: Column, n: Column) -> Column:
    def from_mean(m: Column) -> Column:
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / (n - 1))

    return F.transform(F.array(_array_mean(x, n)), from_mean)[0]


def _array_median(x: Column) -> Column:
    s = F.array_sort(x)
    n = F.size(x)
    return F.transform(F.array(s), lambda v: (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)[0]


class Frame:
    """Columns of one window length."""

    def __init__(self, p: int):
        self.p = p
        self.w = trail(p)
        self.dw = ordered().rowsBetween(-(p - 1), -1)
        self.prices = F.collect_list("close").over(self.w)
        self.returns = F.collect_list("r").over(self.w)
        self.close, self.last, self.first = F.col("close"), F.lag("close", 1).over(ordered()), F.lag("close", p).over(ordered())

    def agg(self, f, x="close") -> Column:
        return f(x).over(self.w)


def _std(f):
    return f.agg(F.stddev_samp, "r")


def _zscore(f):
    return _div(f.last - f.agg(F.avg), f.agg(F.stddev_samp))


def _moment(power: int, excess: float):
    def build(f: Frame) -> Column:
        n = f.p
        raw = f.agg(F.skewness if power == 3 else F.kurtosis)
        scaled = raw * ((n - 1) / n) ** 1.5 if power == 3 else (raw + 3) * ((n - 1) / n) ** 2 - 3
        return F.when(f.agg(F.stddev_samp) == 0, 0.0).otherwise(scaled)

    return build


def _iqr(f):
    n = f.p
    s = F.array_sort(f.returns)
    return F.transform(F.array(s), lambda v: F.get(v, F.lit(int(0.75 * (n - 1)))) - F.get(v, F.lit(int(0.25 * (n - 1)))))[0]


def _mad(f):
    n = F.lit(f.p)
    x = f.returns
    return F.transform(F.array(_array_mean(x, n)), lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v - m)) / n)[0]


def _autocorr(f):
    x, n = f.returns, f.p

    def of(m: Column) -> Column:
        pairs = F.zip_with(F.slice(x, 1, n - 1), F.slice(x, 2, n - 1), lambda a, b: (a - m) * (b - m))
        below = F.aggregate(F.slice(x, 1, n - 1), F.lit(0.0), lambda s, v: s + (v - m) * (v - m))
        return _div(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v), below)

    return F.transform(F.array(_array_mean(x, F.lit(n))), of)[0]


def _entropy(f):
    low, high, x, n = f.agg(F.min), f.agg(F.max), f.prices, f.p
    width = (high - low) / 10

    def share(bins: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.size(F.filter(bins, lambda b: b == k)) / n)
        return -F.aggregate(F.filter(counts, lambda q: q > 0), F.lit(0.0), lambda s, q: s + q * F.ln(q))

    bins = F.transform(x, lambda v: F.least(F.floor(F.try_divide(v - low, width)), F.lit(9)).cast("int"))
    return F.when(width == 0, 0.0).otherwise(F.transform(F.array(bins), share)[0])


def _fractal(f):
    eps = f.agg(F.stddev_samp) / 4
    steps = F.size(F.filter(F.collect_list("d").over(f.dw), lambda v: F.abs(v) > eps))
    return F.when((eps == 0) | (steps == 0), 1.0).otherwise(1.0 + F.ln(steps) / float(np.log(f.p)))


def _maxdd(f):
    start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("dd"))

    def step(a: Column, v: Column) -> Column:
        peak = F.greatest(a.peak, v)
        return F.struct(peak.alias("peak"), F.greatest(a.dd, F.coalesce(F.try_divide(peak - v, peak), F.lit(0.0))).alias("dd"))

    return F.aggregate(f.prices, start, step, lambda a: a.dd)


def _fisher(f):
    m = _momentum(f)
    return F.when(F.abs(m) < 1, 0.5 * F.ln(F.try_divide(1 + m, 1 - m)))


def _momentum(f):
    return F.try_divide(f.first, f.last) - 1


def _chande(f):
    up, down = (F.sum(F.greatest(s * F.col("d"), F.lit(0.0))).over(f.dw) for s in (1, -1))
    return _div(up - down, up + down)


def _effratio(f):
    return _div(f.last - f.first, F.sum(F.abs("d")).over(f.dw))


def _corrskew(p: int) -> Column:
    """Twice the correlation with the series ``lag`` rows before (column ``__lag_{p}``), scaled as a sum over n of ddof-1 deviations."""
    m = p - min(5, p // 2)
    w = ordered().rowsBetween(-m, -1)
    spread = F.stddev_pop("close").over(w) * F.stddev_pop(f"__lag_{p}").over(w)
    return F.when(spread == 0, 0.0).otherwise(2 * F.try_divide(F.covar_pop("close", f"__lag_{p}").over(w), spread) * (m - 1) / m)


def _jumpvol(f):
    x = f.prices
    logs = F.zip_with(F.slice(x, 1, f.p - 1), F.slice(x, 2, f.p - 1), lambda a, b: F.ln(F.try_divide(a, b)))

    def of_deviations(dev: Column) -> Column:
        return F.transform(F.array(_array_median(dev)), lambda mad: F.when(mad == 0, 0.0).otherwise(F.size(F.filter(dev, lambda v: v > 3.0 * mad)) / F.size(dev)))[0]

    def of_logs(v: Column) -> Column:
        return F.transform(F.array(_array_median(v)), lambda med: F.transform(F.array(F.transform(v, lambda z: F.abs(z - med))), of_deviations)[0])[0]

    return F.transform(F.array(logs), of_logs)[0]


def _volskew(f):
    up, down = (F.stddev_samp(F.greatest(s * F.col("d"), F.lit(0.0))).over(f.dw) for s in (1, -1))
    return _div(up - down, up + down)


def _vwapdevz(f):
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    volume = F.sum("volume").over(f.w)
    vwap = F.when(volume > 0, F.try_divide(F.sum(typical * F.col("volume")).over(f.w), volume)).otherwise(F.lag(typical, 1).over(ordered()))
    return (f.last - vwap) / F.greatest(f.agg(F.stddev_samp), F.lit(1e-8))


def _volzscore(f):
    w = ordered().rowsBetween(-f.p, -2)
    sd = F.stddev_pop("volume").over(w)
    return F.when(sd <= 1e-8, 0.0).otherwise((F.lag("volume", 1).over(ordered()) - F.avg("volume").over(w)) / sd)


def hurst(prices: pd.Series) -> pd.Series:
    """Mean log of range over deviation of every prefix, over the log of the length; 0.5 if there is none."""

    def block(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        total, count = np.zeros(len(x)), np.zeros(len(x))
        for k in range(2, n + 1):
            part = x[:, :k]
            s, span = part.std(axis=1, ddof=1), np.ptp(part, axis=1)
            good = (s > 0) & (span > 0)
            total[good] += np.log(span[good] / s[good])
            count += good
        return np.where((count > 0) & (n > 1), total / np.maximum(count, 1) / max(np.log(n), 1e-300), 0.5)

    return _by_length(prices, block)


def approximate_entropy(prices: pd.Series) -> pd.Series:
    """Embedding 2, tolerance a fifth of the deviation, self-matches left out."""

    def block(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n <= 3:
            return np.zeros(len(x))
        out = []
        for row in x:
            close = np.abs(row[:, None] - row[None, :]) <= 0.2 * row.std(ddof=1)
            two = close[:-1, :-1] & close[1:, 1:]
            three = two[:-1, :-1] & close[2:, 2:]
            a, b = two.sum() - (n - 1), three.sum() - (n - 2)
            out.append((np.log(a / (n - 1)) if a > 0 else 0.0) - (np.log(b / (n - 2)) if b > 0 else 0.0))
        return np.array(out)

    return _by_length(prices, block)


def _by_length(prices: pd.Series, block: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    out = np.full(len(prices), np.nan)
    sizes = np.array([0 if x is None else len(x) for x in prices])
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        out[at] = block(np.stack([np.asarray(prices.iloc[i], float) for i in at]))
    return pd.Series(out)


BUILDERS: dict[str, Callable[[Frame], Column]] = {
    "std": _std,
    "mean": lambda f: f.agg(F.avg, "r"),
    "median": lambda f: F.percentile("r", 0.5).over(f.w),
    "iqr": _iqr,
    "mad": _mad,
    "sharpe": lambda f: _div(f.agg(F.avg, "r"), f.agg(F.stddev_samp, "r")),
    "autocorr": _autocorr,
    "skew": _moment(3, 0),
    "kurt": _moment(4, 3),
    "zscore": _zscore,
    "range": lambda f: f.agg(F.max) - f.agg(F.min),
    "cv": lambda f: _div(f.agg(F.stddev_samp), f.agg(F.avg)),
    "var": lambda f: f.agg(F.var_pop),
    "entropy": _entropy,
    "slope": lambda f: F.regr_slope("close", "rn").over(f.w),
    "momentum": _momentum,
    "fractal": _fractal,
    "hurst": lambda f: F.pandas_udf(hurst, "double")(f.prices),
    "maxdd": _maxdd,
    "fisher": _fisher,
    "chande": _chande,
    "approxentropy": lambda f: F.pandas_udf(approximate_entropy, "double")(f.prices),
    "effratio": _effratio,
    "corrskew": lambda f: _corrskew(f.p),
    "jumpvol": _jumpvol,
    "volskew": _volskew,
    "vwapdevz": _vwapdevz,
    "volzscore": _volzscore,
}
STATISTICS = tuple(BUILDERS)


def features(bars: DataFrame, wanted: list[tuple[int, str, str]]) -> DataFrame:
    """``bars`` with a column ``{period}_{statistic}_{role}_feature`` for every (period, statistic, role).

    One pass: all frames share the partitioning and order of the series, so Spark sorts once. Arrays are framed first
    and read by the array statistics afterwards.
    """
    base = with_base(bars)
    framed, names = {}, {}
    for p, stat, role in dict.fromkeys(wanted):
        if stat not in BUILDERS:
            raise ValueError(f"unknown statistic {stat}")
        if p < 3:
            raise ValueError(f"a window of {p} rows is too short")
        names[f"{p}_{stat}_{role}_feature"] = (p, stat)
        if stat == "corrskew":
            framed[f"__lag_{p}"] = F.lag("close", min(5, p // 2)).over(ordered())
    base = base.withColumns(framed) if framed else base
    out = {}
    for name, (p, stat) in names.items():
        value = BUILDERS[stat](Frame(p))
        out[name] = F.when(F.col("rn") >= p + (stat in ON_RETURNS), value)
    return base.withColumns(out).drop(*framed)


def feature(bars: DataFrame, stat: str, p: int = 12) -> DataFrame:
    name = f"{p}_{stat}_main_feature"
    return features(bars, [(p, stat, "main")]).select("symbol", "bar", F.round(F.col(name), 6).alias("value"))


def rounded(df: DataFrame, precision: int = 6) -> DataFrame:
    """Feature columns rounded half to even; infinite and undefined values become null."""
    clean = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.bround(c, precision))
    return df.withColumns({c: clean(c) for c in df.columns if c.endswith("_feature")})
