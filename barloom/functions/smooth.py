"""Smoothers and sequential primitives over one ordered series.

Finite frames are window aggregates. ATR and EMA carry unbounded state and run as one Arrow batch per series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import SERIES, ahead, every, incl, ordered


def per_series(df: DataFrame, kernel: Callable[[pd.DataFrame], dict[str, np.ndarray]], added: str) -> DataFrame:
    """``df`` with the columns ``added`` (DDL) that ``kernel`` computes from each series in bar order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + added

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar", kind="stable")
        return pdf.assign(**kernel(pdf))

    return df.groupBy(SERIES).applyInPandas(run, schema)


def true_range() -> Column:
    prev = F.lag("close").over(ordered())
    return F.coalesce(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)), F.col("high") - F.col("low"))


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """``bars`` with tr and Wilder's atr: a running mean for the first ``period`` bars, then ((period - 1) * atr + tr) / period."""

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        tr, out, total, value = pdf["tr"].to_numpy(float), np.empty(len(pdf)), 0.0, 0.0
        for i, x in enumerate(tr.tolist()):
            total += x
            value = total / (i + 1) if i < period else (value * (period - 1) + x) / period
            out[i] = value
        return {"atr": out}

    return per_series(bars.withColumn("tr", true_range()), kernel, "atr double")


def ema(df: DataFrame, span: int, x: str = "close", out: str = "ema") -> DataFrame:
    """Exponential mean without bias correction: the first value, then alpha * x + (1 - alpha) * last."""
    alpha = 2.0 / (span + 1)

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        values, last = np.empty(len(pdf)), None
        for i, v in enumerate(pdf[x].tolist()):
            last = v if last is None else alpha * v + (1 - alpha) * last
            values[i] = last
        return {out: values}

    return per_series(df, kernel, f"{out} double")


def forward_median(first: int, last: int, x: str = "close") -> Column:
    """Median of rows i + first .. i + last; shorter at the end of the series."""
    return F.percentile(x, 0.5).over(ahead(first, last))


def sma(x: str, w: int) -> Column:
    return F.avg(x).over(incl(w))


def rolling_std(x: str, w: int) -> Column:
    return F.stddev_pop(x).over(incl(w))


def gradient(x: str) -> Column:
    """Central differences, one-sided at both ends."""
    before, after = F.lag(x).over(ordered()), F.lead(x).over(ordered())
    return F.when(before.isNull(), after - F.col(x)).when(after.isNull(), F.col(x) - before).otherwise((after - before) / 2)


def savgol_weights(window: int, polyorder: int, at: int | None = None) -> np.ndarray:
    """Weights that give the least-squares polynomial of ``window`` points at point ``at`` (the middle by default)."""
    at = window // 2 if at is None else at
    x = np.arange(window, dtype=float) - at
    return np.linalg.pinv(np.vander(x, polyorder + 1, increasing=True))[0]


def savgol(x: str, window: int, polyorder: int, n: Column, rn: Column) -> Column:
    """Savitzky-Golay smoothing: fixed weights over a centred frame; the first and last half windows
    evaluate the polynomial fitted to the first and last whole window. The window is made odd; a series shorter than it has null."""
    window += 1 - window % 2
    half = window // 2
    if window <= polyorder:
        raise ValueError("the window must be longer than the polynomial order")
    w = ordered()

    def dot(weights: np.ndarray, start: int) -> Column:
        total = F.lit(0.0)
        for k, c in enumerate(weights):
            shift = start + k
            value = F.col(x) if shift == 0 else F.lag(x, -shift).over(w) if shift < 0 else F.lead(x, shift).over(w)
            total = total + float(c) * value
        return total

    out = F.when((rn >= half) & (rn < n - half), dot(savgol_weights(window, polyorder), -half))
    for k in range(half):
        out = out.when(rn == k, dot(savgol_weights(window, polyorder, k), -k))
        out = out.when(rn == n - 1 - k, dot(savgol_weights(window, polyorder, window - 1 - k), k + 1 - window))
    return F.when(n >= window, out)


def with_size(df: DataFrame) -> DataFrame:
    """Adds rn (from 0) and n, the length of the series."""
    return df.withColumns({"rn": F.row_number().over(ordered()) - 1, "n": F.count("*").over(every())})


def quantile_bins(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """(symbol, edges): distinct edges of equal-frequency bins of every series."""
    steps = [k / bins for k in range(bins + 1)]
    return df.groupBy(SERIES).agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(q) for q in steps]))).alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """Right-closed bin, from 0; the lowest edge belongs to the first bin; null outside."""
    below = F.size(F.filter(edges, lambda e: e < x))
    inside = (x >= F.get(edges, F.lit(0))) & (x <= F.get(edges, F.size(edges) - 1))
    return F.when(inside, F.greatest(below - 1, F.lit(0)))
