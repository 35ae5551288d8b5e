"""Scores of equity curves, with two profiles whose constants differ on purpose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    weights: dict[str, float]
    knee: float  # a lower R2 is scaled by 0.4
    least_trades: int
    least_rdd: float
    base: tuple[int, int]  # least walk-forward window, and the part of the trades
    step_part: int
    window_weights: tuple[float, float, float]
    cv_factor: float
    power: float


#: Fixed values of the two profiles.
RESEARCH = Profile({"r2": 0.25, "slope": 0.10, "rdd": 0.07, "trades": 0.03, "walk": 0.55}, 0.80, 0, float("-inf"), (15, 10), 8, (0.20, 0.35, 0.45), 3.5, 2.0)
TERMINAL = Profile({"r2": 0.20, "slope": 0.20, "rdd": 0.10, "trades": 0.05, "walk": 0.45}, 0.70, 200, 2.0, (10, 20), 4, (0.50, 0.30, 0.20), 2.0, 1.5)


#: Minutes of a bar by time frame; a trading week has 5 days of 22 hours, a year 252 of them.
MINUTES = {"M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1320}


def periods_per_year(timeframe: str) -> float:
    """Bars of a year; unknown time frames count as H1."""
    return 22 * 60 * 5 * 252 / MINUTES.get(timeframe, 60)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def drawdown(equity: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("drawdown", F.max("equity").over(w) - F.col("equity"))


def curve_metrics(equity: DataFrame) -> DataFrame:
    """(symbol, n_points, total, max_dd, rdd, slope, r2): linear fit over the point number; flat curves have r2 0."""
    m = drawdown(equity).groupBy("symbol").agg(
        F.count("*").alias("n_points"),
        (F.max_by("equity", "point") - F.min_by("equity", "point")).alias("total"),
        F.max("drawdown").alias("max_dd"),
        F.regr_slope("equity", "point").alias("slope"),
        F.when(F.var_pop("equity") < 1e-12, 0.0).otherwise(F.regr_r2("equity", "point")).alias("r2"),
    )
    return m.withColumn("rdd", F.when(F.col("max_dd") == 0, 0.0).otherwise(F.try_divide("total", "max_dd")))


def walk_forward(trades: DataFrame, profile: Profile = RESEARCH) -> DataFrame:
    """(symbol, walk): consistency over overlapping windows of trades at up to three scales.

    A window's profit is a difference of running sums, so windows need two lookups by trade number, not a range join over their trades.
    """
    w = Window.partitionBy("symbol").orderBy("trade_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = trades.select("symbol", (F.col("trade_no") + 1).alias("k"), F.sum("profit").over(w).alias("eq"), F.sum(F.when(F.col("profit") > 0, 1).otherwise(0)).over(w).alias("wins"))
    sums = sums.union(trades.select("symbol", F.lit(0).cast("long"), F.lit(0.0), F.lit(0).cast("long")).distinct())
    n = trades.groupBy("symbol").agg(F.count("*").alias("n"))
    least, part = profile.base
    w1 = F.greatest(F.lit(least), F.floor(F.col("n") / part)).cast("long")
    w2, w3 = F.least(2 * w1, F.floor(F.col("n") / 5)).cast("long"), F.least(3 * w1, F.floor(F.col("n") / 4)).cast("long")
    a, b, c = profile.window_weights
    struct = lambda size, weight: F.struct(size.alias("size"), F.lit(weight).alias("weight"))
    scales = F.filter(F.array(F.when(w1 >= 5, struct(w1, a)), F.when((w2 > w1) & (w2 >= 5), struct(w2, b)), F.when((w3 > w2) & (w3 >= 5), struct(w3, c))), lambda x: x.isNotNull())
    sized = n.where(F.col("n") >= w1).select("symbol", "n", F.explode(scales).alias("s")).select("symbol", "n", "s.size", "s.weight")
    sized = sized.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("symbol"))).where("n >= size")
    step = F.greatest(F.lit(1), F.floor(F.col("size") / profile.step_part)).cast("long")
    starts = sized.select("symbol", "size", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("size"), step)).alias("from"))
    starts = starts.withColumn("upto", F.col("from") + F.col("size"))
    lo, hi = sums.toDF("symbol", "from", "eq0", "wins0"), sums.toDF("symbol", "upto", "eq1", "wins1")
    seen = starts.join(lo, ["symbol", "from"]).join(hi, ["symbol", "upto"]).select("symbol", "size", "weight", (F.col("eq1") - F.col("eq0")).alias("r"), ((F.col("wins1") - F.col("wins0")) / F.col("size")).alias("share"))
    scored = seen.groupBy("symbol", "size", "weight").agg(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("good"), F.avg("share").alias("share"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.count("*").alias("k"))
    steady = F.when((F.col("k") >= 3) & (F.col("sd") > 0), 1.0 / (1.0 + profile.cv_factor * F.col("sd") / (F.abs("mean") + 1e-8))).otherwise(1.0)
    total = scored.groupBy("symbol").agg(F.sum(F.col("good") * F.col("share") * steady * F.col("weight")).alias("t"))
    return n.join(total, "symbol", "left").select("symbol", F.least(F.lit(1.0), F.pow(F.coalesce("t", F.lit(0.0)), profile.power)).alias("walk"))


def report(trades: DataFrame, profile: Profile = RESEARCH) -> DataFrame:
    """(symbol, trades, rdd, r2, slope, walk, score); -1 throughout for curves that end no higher than they began or fall."""
    from barloom.operators.backtest import equity_curve

    m = curve_metrics(equity_curve(trades)).join(walk_forward(trades, profile), "symbol")
    bad = (F.col("n_points") < 2) | (F.col("total") <= 0) | (F.col("slope") < 0) | (F.col("n_points") - 1 < profile.least_trades) | (F.col("rdd") < profile.least_rdd)
    parts = {
        "trades": sigmoid((F.col("n_points") - 1 - 200) / 1000.0),
        "rdd": sigmoid((F.col("rdd") - 2.0) / 6.0),
        "r2": F.when(F.col("r2") < profile.knee, F.col("r2") * 0.4).otherwise(0.40 + (F.col("r2") - profile.knee) * (0.6 / (1 - profile.knee))),
        "slope": sigmoid(F.log1p("slope") / 3.0),
        "walk": F.col("walk"),
    }
    score = sum((w * parts[k] for k, w in profile.weights.items()), F.lit(0.0))
    return m.select("symbol", *[F.when(bad, -1.0).otherwise(v).alias(k) for k, v in parts.items()], F.when(bad, -1.0).otherwise(score).alias("score"))
