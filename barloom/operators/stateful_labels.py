"""Labelers with state that no window frame holds: symmetric patterns, cluster jumps and validated levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import ordered
from barloom.functions.smooth import per_series
from barloom.operators.labels import DIRECTIONS


def pattern_windows(df: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(symbol, start, w, corr): for every start the even window whose first half correlates most with its reversed, negated second half;
    of equals the shortest. Window lengths are rows, so the search runs in parallel; flat halves are skipped."""
    first = shortest + shortest % 2
    ahead = F.collect_list("close").over(ordered().rowsBetween(0, longest - 1))
    starts = df.select("symbol", F.col("rn").alias("start"), ahead.alias("a"))
    sized = starts.select("symbol", "start", "a", F.explode(F.sequence(F.lit(first), F.lit(longest), F.lit(2))).alias("w")).where(F.size("a") >= F.col("w"))
    half = (F.col("w") / 2).cast("int")
    x, y = F.slice("a", 1, half), F.transform(F.reverse(F.slice("a", half + 1, half)), lambda v: -v)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, z: s + z) / half
    halves = sized.select("symbol", "start", "w", x.alias("x"), y.alias("y"), mean(x).alias("mx"), mean(y).alias("my"))
    dot = lambda u, v, mu, mv: F.aggregate(F.zip_with(u, v, lambda p, q: (p - F.col(mu)) * (q - F.col(mv))), F.lit(0.0), lambda s, z: s + z)
    sums = halves.select("symbol", "start", "w", dot("x", "y", "mx", "my").alias("xy"), dot("x", "x", "mx", "mx").alias("xx"), dot("y", "y", "my", "my").alias("yy"))
    n = F.col("w") / 2
    good = (F.sqrt(F.col("xx") / n) > 1e-9) & (F.sqrt(F.col("yy") / n) > 1e-9)
    corr = F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 9)
    best = sums.where(good).withColumn("corr", corr)
    return best.groupBy("symbol", "start").agg(F.max_by(F.struct("w", "corr"), F.struct(F.abs("corr"), -F.col("w"))).alias("m")).select("symbol", "start", "m.w", "m.corr")


def fractal(df: DataFrame, shortest: int, longest: int, threshold: float, markup: float, horizon: int, direction: str = "both") -> DataFrame:
    """Adds label: a bar takes its own outcome if the last-starting window over it is reliable, else 2. ``df`` as made by ``labels.prepared``."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    windows = pattern_windows(df, shortest, longest)
    points = windows.select("symbol", "start", (F.abs("corr") >= threshold).alias("reliable"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("w") - 1)).alias("rn"))
    last = points.groupBy("symbol", "rn").agg(F.max_by("reliable", "start").alias("reliable"))
    later, m = F.lead("close", horizon).over(ordered()), markup * F.col("atr")
    up, down = later > F.col("close") + m, later < F.col("close") - m
    value = F.when(up, 0.0).when(down, 1.0).otherwise(2.0) if direction == "both" else F.when(up if direction == "buy" else down, 1.0).otherwise(0.0)
    own = df.withColumn("own", F.when(later.isNull(), 2.0).otherwise(value)).join(last, ["symbol", "rn"], "left")
    return own.withColumn("label", F.when(F.col("reliable"), F.col("own")).otherwise(2.0)).drop("own", "reliable")


def cluster_jumps(df: DataFrame, cluster: str, markup: float) -> DataFrame:
    """Adds label: 0 or 1 where the cluster differs from that of the last jump and the price moved by more than m up or down since, else 2."""

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        c, k, m = pdf["close"].to_numpy(float), pdf[cluster].to_numpy(), markup * pdf["atr"].to_numpy(float)
        out, now, price = np.full(len(c), 2.0), k[0], c[0]
        for i in range(1, len(c)):
            if k[i] != now and abs(c[i] - price) > m[i]:
                out[i] = 0.0 if c[i] > price else 1.0
                now, price = k[i], c[i]
        return {"label": out}

    return per_series(df, kernel, "label double")


def validated_levels(df: DataFrame, window: int, least_touches: int, markup: float, last: int, direction: str = "both") -> DataFrame:
    """Adds label: breaks of supports and resistances that were touched often enough. The level book keeps its insertion order;
    a new level overwrites one at exactly its price."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")

    def touch(book: dict[float, int], price: float, fresh: float, reach: float) -> None:
        for level in book:
            if abs(price - level) <= reach:
                book[level] += 1
                return
        book[fresh] = 1

    def nearest(book: dict[float, int], price: float) -> float | None:
        valid = [x for x, n in book.items() if n >= least_touches]
        return min(valid, key=lambda x: abs(x - price)) if valid else None

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        h, lo, c, f = (pdf[x].to_numpy(float) for x in ("high", "low", "close", "fwd"))
        m = markup * pdf["atr"].to_numpy(float)
        out = np.full(len(c), 2.0)
        above: dict[float, int] = {}
        below: dict[float, int] = {}
        for i in range(window, len(c) - last):
            touch(above, h[i], h[i - window : i].max(), 0.5 * m[i])
            touch(below, lo[i], lo[i - window : i].min(), 0.5 * m[i])
            for book in (above, below):
                for level in [x for x in book if abs(x - c[i]) > 3 * m[i]]:
                    del book[level]
            r, s = nearest(above, c[i]), nearest(below, c[i])
            broke_up, broke_down = r is not None and c[i] > r + m[i], s is not None and c[i] < s - m[i]
            gain, fall = f[i] >= c[i] + m[i], f[i] <= c[i] - m[i]
            if direction == "both":
                out[i] = 0.0 if broke_up and gain else 1.0 if broke_down and fall else 2.0
            else:
                zone, good = (broke_up, gain) if direction == "buy" else (broke_down, fall)
                out[i] = (1.0 if good else 0.0) if zone else 2.0
        return {"label": out}

    return per_series(df, kernel, "label double")


def extremes(x: np.ndarray, prominence: float) -> np.ndarray:
    """Whether each point is a local maximum (the middle of a flat top) that stands at least ``prominence`` above the higher of its two bases;
    a base is the lowest point on the way to the next higher point, or to the end of the series."""
    out, n, i = np.zeros(len(x), bool), len(x), 1
    while i < n - 1:
        if x[i] > x[i - 1]:
            end = i
            while end < n - 1 and x[end + 1] == x[i]:
                end += 1
            if end < n - 1 and x[end + 1] < x[i]:
                out[(i + end) // 2] = True
            i = end
        i += 1
    for p in np.flatnonzero(out):
        higher = np.flatnonzero(x[:p] > x[p])
        left = x[(higher[-1] + 1 if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : (p + 1 + higher[0] if len(higher) else n)].min()
        out[p] = x[p] - max(left, right) >= prominence
    return out


def prominent_extremes(df: DataFrame, prominence: float = 0.1) -> DataFrame:
    """Adds peak and trough: extremes of close that stand out by ``prominence`` in price units."""

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        c = pdf["close"].to_numpy(float)
        return {"peak": extremes(c, prominence), "trough": extremes(-c, prominence)}

    return per_series(df, kernel, "peak boolean, trough boolean")
