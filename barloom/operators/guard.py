"""Change-point guard over the profit of consecutive trades: sudden shocks and slow erosion."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    burn_in: int
    shock_z: float
    erosion_window: int
    l_min: int
    m_consecutive: int


#: Fixed values of the three levels.
LEVELS = {"low": Level(40, 3.5, 96, 30, 5), "medium": Level(30, 3.0, 64, 20, 3), "high": Level(20, 2.5, 48, 15, 2)}


def returns_of(equity: DataFrame) -> DataFrame:
    """(symbol, point, ret): changes of the curve, 0 at its start."""
    w = Window.partitionBy("symbol").orderBy("point")
    return equity.withColumn("ret", F.coalesce(F.col("equity") - F.lag("equity").over(w), F.lit(0.0)))


def median_and_scale(x: Column) -> Column:
    """struct(med, scale) of an array: the median, and 1.4826 * MAD (1 if that is nearly 0)."""

    def median(v: Column) -> Column:
        s = F.array_sort(v)
        n = F.size(v)
        return F.transform(F.array(s), lambda z: (F.get(z, F.floor((n - 1) / 2).cast("int")) + F.get(z, F.floor(n / 2).cast("int"))) / 2)[0]

    def scaled(m: Column) -> Column:
        mad = 1.4826 * median(F.transform(x, lambda v: F.abs(v - m)))
        return F.struct(m.alias("med"), F.when(mad <= 1e-12, 1.0).otherwise(mad).alias("scale"))

    return F.transform(F.array(median(x)), scaled)[0]


def robust_scale(equity: DataFrame, burn_in: int = 30) -> DataFrame:
    """(symbol, med, scale) of the first ``burn_in`` returns."""
    head = returns_of(equity).where(F.col("point") < burn_in).groupBy("symbol").agg(F.collect_list("ret").alias("x"))
    return head.select("symbol", median_and_scale(F.col("x")).alias("s")).select("symbol", "s.med", "s.scale")


def shock_index(equity: DataFrame, level: Level) -> DataFrame:
    """(symbol, idx_shock): the first point whose return lies ``shock_z`` robust deviations below those before it."""
    w = Window.partitionBy("symbol").orderBy("point")
    size = max(4, level.burn_in)
    framed = returns_of(equity).withColumns({"x": F.collect_list("ret").over(w.rowsBetween(-size, -1)), "n": F.count("*").over(Window.partitionBy("symbol"))})
    late = framed.where((F.col("point") >= level.burn_in) & (F.col("n") > level.burn_in + 1)).withColumn("s", median_and_scale(F.col("x")))
    return late.where((F.col("ret") - F.col("s.med")) / F.col("s.scale") < -level.shock_z).groupBy("symbol").agg(F.min("point").alias("idx_shock"))


def erosion_index(equity: DataFrame, level: Level) -> DataFrame:
    """(symbol, idx_erosion): where the smoothed return has been negative ``m_consecutive`` times after the grace period."""
    alpha = 2.0 / (max(2, level.erosion_window) + 1)
    grace = level.burn_in + level.l_min

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("point")["ret"].to_numpy(float)
        smooth, low, at = 0.0, 0, None
        for t, v in enumerate(x.tolist()):
            smooth = v if t == 0 else alpha * v + (1 - alpha) * smooth
            if t >= grace:
                low = low + 1 if smooth < 0 else 0
                if low >= level.m_consecutive and len(x) > grace + 1:
                    at = t
                    break
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "idx_erosion": pd.array([at], dtype="Int64")})

    return returns_of(equity).groupBy("symbol").applyInPandas(run, "symbol string, idx_erosion long").where("idx_erosion is not null")


def change_point_guard(equity: DataFrame, level: str = "medium") -> DataFrame:
    """(symbol, idx_shock, idx_erosion, stable); curves of fewer than 10 points are stable."""
    chosen = LEVELS[level]
    every = equity.groupBy("symbol").agg(F.count("*").alias("n"))
    both = every.join(shock_index(equity, chosen), "symbol", "left").join(erosion_index(equity, chosen), "symbol", "left")
    long_ = F.col("n") >= 10
    out = both.select("symbol", F.when(long_, F.col("idx_shock")).alias("idx_shock"), F.when(long_, F.col("idx_erosion")).alias("idx_erosion"))
    return out.withColumn("stable", F.col("idx_shock").isNull() & F.col("idx_erosion").isNull())
