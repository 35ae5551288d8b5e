"""Random-position test: is the Sharpe ratio better than that of shuffled positions?

Randomness is a hash of (seed, simulation, draw), so results are repeatable and the same in any engine. Simulations are rows: positions are
exchanged by equi-joins on the row number, and a simulation's Sharpe ratio is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import every, ordered


def draw(*parts: Column, below: Column) -> Column:
    """A number in [0, below) from the MD5 of the joined parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long"), below)


def sharpe(x: Column) -> Column:
    return F.coalesce(F.try_divide(F.avg(x), F.when(F.stddev_pop(x) > 0, F.stddev_pop(x))), F.lit(0.0))


def sanitised(pos: Column, direction: str) -> Column:
    return F.greatest(pos, F.lit(0)) if direction == "buy" else F.least(pos, F.lit(0)) if direction == "sell" else pos


def run_lengths(positions: DataFrame) -> DataFrame:
    """(symbol, run, pos, length) of runs of equal positions."""
    w = ordered()
    starts = F.when(F.lag("pos").over(w) == F.col("pos"), 0).otherwise(1)
    marked = positions.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("symbol", "run").agg(F.first("pos").alias("pos"), F.count("*").alias("length"))


def block_size(positions: DataFrame) -> DataFrame:
    """(symbol, block): median run length, rounded down, within 5 and 64; short series take their own length, 2 at least."""
    med = run_lengths(positions).groupBy("symbol").agg(F.floor(F.percentile("length", 0.5)).alias("med"), F.sum("length").alias("n"))
    return med.select("symbol", F.when(F.col("n") < 10, F.greatest(F.lit(2), F.col("n"))).otherwise(F.least(F.greatest("med", F.lit(5)), F.lit(64))).cast("long").alias("block"))


def simulations(positions: DataFrame, n_sims: int, seed: int = 1) -> DataFrame:
    """(symbol, sim, rn, pos): even simulations shift the positions around the circle, odd ones lay blocks of them end to end."""
    base = positions.select("symbol", (F.row_number().over(ordered()) - 1).cast("long").alias("rn"), F.count("*").over(every()).alias("n"), "pos")
    sizes = base.groupBy("symbol").agg(F.max("n").alias("n")).join(block_size(positions), "symbol")
    sims = sizes.select("symbol", "n", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sims - 1).cast("long"))).alias("sim"))
    low, high = F.greatest(F.lit(2), F.floor(F.col("block") * 0.5)), F.least(F.lit(64), F.floor(F.col("block") * 1.5))
    size = low + draw(F.lit(seed), F.col("symbol"), F.col("sim"), F.lit("size"), below=F.greatest(high, low) - low + 1)
    sims = sims.withColumn("size", F.least(size, F.col("n")).cast("long")).withColumn("shift", draw(F.lit(seed), F.col("symbol"), F.col("sim"), F.lit("shift"), below=F.col("n")))
    rows = sims.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t"))
    start = draw(F.lit(seed), F.col("symbol"), F.col("sim"), F.floor(F.col("t") / F.col("size")), below=F.col("n"))
    source = F.when(F.col("sim") % 2 == 0, F.pmod(F.col("t") - F.col("shift"), F.col("n"))).otherwise(F.pmod(start + F.col("t") % F.col("size"), F.col("n")))
    picked = rows.select("symbol", "sim", "t", source.alias("rn"))
    return picked.join(base.select("symbol", "rn", "pos"), ["symbol", "rn"]).select("symbol", "sim", F.col("t").alias("rn"), "pos")


def simulated_sharpes(positions: DataFrame, n_sims: int, seed: int = 1) -> DataFrame:
    """(symbol, sim, sharpe) of the simulated positions on the actual opens."""
    w = ordered()
    moves = positions.select("symbol", (F.row_number().over(w)).cast("long").alias("rn"), F.lead("open").over(w).alias("next"), "open")
    moves = moves.select("symbol", (F.col("rn") - 1).alias("rn"), F.coalesce(F.try_divide(F.col("next") - F.col("open"), F.col("open")), F.lit(0.0)).alias("move"))
    joined = simulations(positions, n_sims, seed).join(moves, ["symbol", "rn"])
    # the position of the last row has no later move; the first return is 0, so every series keeps n returns
    return joined.groupBy("symbol", "sim").agg(sharpe(F.col("pos") * F.col("move")).alias("sharpe"))


def monkey_test(positions: DataFrame, n_sims: int = 1000, direction: str = "both", seed: int = 1) -> DataFrame:
    """(symbol, sharpe, p_value, percentile). Too little exposure (50 bars, 200 exposed, 30 entries) gives p 1."""
    from barloom.operators.backtest import bar_returns

    clean = positions.withColumn("pos", sanitised(F.col("pos"), direction))
    returns = bar_returns(positions)
    entered = F.when((F.col("pos") != 0) & (F.coalesce(F.lag("pos").over(ordered()), F.lit(0)) == 0), 1).otherwise(0)
    actual = returns.withColumn("entered", entered).groupBy("symbol").agg(sharpe(F.col("ret")).alias("sharpe"), F.count("*").alias("n"), F.count_if(F.col("pos") != 0).alias("exposed"), F.sum("entered").alias("entries"))
    sims = simulated_sharpes(clean, n_sims, seed).withColumnRenamed("sharpe", "s")
    beaten = sims.join(actual.select("symbol", "sharpe"), "symbol").groupBy("symbol").agg(F.count_if(F.col("s") >= F.col("sharpe")).alias("k"), F.count("*").alias("sims"))
    enough = (F.col("n") >= 50) & (F.col("exposed") >= 200) & (F.col("entries") >= 30)
    p = F.when(enough, (F.col("k") + 1.0) / (F.col("sims") + 1.0)).otherwise(1.0)
    return actual.join(beaten, "symbol", "left").select("symbol", "sharpe", p.alias("p_value"), F.when(enough, 100 * (1 - p)).otherwise(0.0).alias("percentile"))
