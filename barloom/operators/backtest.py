"""Signals, bar-by-bar backtest, position series and trade statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import ordered
from barloom.operators.labels import DIRECTIONS

TRADES = "symbol string, trade_no long, side string, entry_bar timestamp_ntz, exit_bar timestamp_ntz, profit double"


def signals(p: Column, q: Column, threshold: float, meta_threshold: float, direction: str = "both") -> tuple[Column, Column, Column]:
    """(buy, sell, gate) from the main and meta probabilities, all strict."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    no = F.lit(False)
    buy = p > threshold if direction == "buy" else (1 - p) > threshold if direction == "both" else no
    sell = p > threshold if direction != "buy" else no
    return buy, sell, q > meta_threshold


def replay(opens: np.ndarray, buy: np.ndarray, sell: np.ndarray, gate: np.ndarray, most_orders: int = 1, delay: int = 1) -> tuple[list[tuple[int, int, int, float]], np.ndarray]:
    """(trades as (side, entry, exit, profit), positions after closing and before opening) of one series; side 1 buys, -1 sells."""
    book: list[tuple[int, float, int]] = []
    trades: list[tuple[int, int, int, float]] = []
    held = np.zeros(len(opens), np.int8)
    last_entry = -delay
    wanted = {1: buy, -1: sell}
    for t, price in enumerate(opens):
        slot = 0
        while slot < len(book):
            side, paid, entered = book[slot]
            if gate[t] and wanted[side][t]:
                slot += 1
                continue
            trades.append((side, entered, t, side * (price - paid)))
            end = book.pop()
            if slot < len(book):
                book[slot] = end
        held[t] = book[0][0] if book else 0
        if gate[t] and t - last_entry >= delay:
            for side in (1, -1):
                if wanted[side][t] and (most_orders == 0 or len(book) < most_orders):
                    book.append((side, price, t))
                    last_entry = t
    for side, paid, entered in book:
        trades.append((side, entered, len(opens) - 1, side * (opens[-1] - paid)))
    return trades, held


def backtest(df: DataFrame, threshold: float, meta_threshold: float, direction: str = "both", most_orders: int = 1, delay: int = 1) -> DataFrame:
    """Trades of every series of ``df`` (symbol, bar, open, p, q), general rules: one Arrow batch per series."""
    buy, sell, gate = signals(F.col("p"), F.col("q"), threshold, meta_threshold, direction)
    ready = df.select("symbol", "bar", "open", buy.alias("buy"), sell.alias("sell"), gate.alias("gate"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar", kind="stable").reset_index(drop=True)
        trades, _ = replay(*(pdf[c].to_numpy() for c in ("open", "buy", "sell", "gate")), most_orders, delay)
        bars = pdf["bar"]
        rows = [(pdf["symbol"][0], k, "buy" if s > 0 else "sell", bars[a], bars[b], float(v)) for k, (s, a, b, v) in enumerate(trades)]
        return pd.DataFrame(rows, columns=["symbol", "trade_no", "side", "entry_bar", "exit_bar", "profit"])

    return ready.groupBy("symbol").applyInPandas(run, TRADES)


def desired(buy: Column, sell: Column, gate: Column) -> Column:
    """Wanted position of exclusive signals."""
    return F.when(gate & buy, 1).when(gate & sell, -1).otherwise(0)


def island_trades(df: DataFrame, threshold: float, meta_threshold: float, direction: str = "both") -> DataFrame:
    """Trades for one order at a time and signals that exclude each other (``both`` needs a threshold of at least 0.5):
    a trade is a run of equal wanted positions, closed at the first bar after it, or at the last bar. Window functions only."""
    if direction == "both" and threshold < 0.5:
        raise ValueError("signals overlap; use backtest")
    want = desired(*signals(F.col("p"), F.col("q"), threshold, meta_threshold, direction))
    w = ordered()
    marked = df.select("symbol", "bar", "open", want.alias("want"))
    marked = marked.withColumn("starts", F.when(F.col("want") == F.lag("want").over(w), 0).otherwise(1))
    marked = marked.withColumns({"island": F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)), "next_bar": F.lead("bar").over(w), "next_open": F.lead("open").over(w)})
    runs = marked.where("want <> 0").groupBy("symbol", "island").agg(
        F.first("want").alias("want"),
        F.min("bar").alias("entry_bar"),
        F.min_by("open", "bar").alias("paid"),
        F.max_by(F.struct(F.coalesce("next_bar", "bar").alias("bar"), F.coalesce("next_open", "open").alias("open")), "bar").alias("end"),
    )
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("island")) - 1
    side = F.when(F.col("want") > 0, "buy").otherwise("sell")
    return runs.select("symbol", number.cast("long").alias("trade_no"), side.alias("side"), "entry_bar", F.col("end.bar").alias("exit_bar"), (F.col("want") * (F.col("end.open") - F.col("paid"))).alias("profit"))


def position_series(df: DataFrame, threshold: float, meta_threshold: float, direction: str = "both", raw: bool = True) -> DataFrame:
    """(symbol, bar, open, pos): the position after closes and before opens, so the bar that opens a trade shows 0;
    ``raw=False`` shows the wanted position instead."""
    want = desired(*signals(F.col("p"), F.col("q"), threshold, meta_threshold, direction))
    marked = df.select("symbol", "bar", "open", want.alias("want"))
    pos = F.when(F.lag("want").over(ordered()) == F.col("want"), F.col("want")).otherwise(0) if raw else F.col("want")
    return marked.select("symbol", "bar", "open", pos.cast("byte").alias("pos"))


def bar_returns(positions: DataFrame) -> DataFrame:
    """Adds ret: the position of the last bar times the relative change of the open."""
    before, prev = F.lag("pos").over(ordered()), F.lag("open").over(ordered())
    ret = F.when((prev == 0) | prev.isNull() | (before == 0), 0.0).otherwise(before * ((F.col("open") - prev) / prev))
    return positions.withColumn("ret", ret)


def trade_stats(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(F.count("*").alias("n_trades"), F.count_if(F.col("profit") > 0).alias("n_wins"), F.count_if(F.col("profit") < 0).alias("n_losses"), F.sum("profit").alias("profit"))


def equity_curve(trades: DataFrame) -> DataFrame:
    """(symbol, point, equity): 0 before the first trade, then the running sum."""
    w = Window.partitionBy("symbol").orderBy("trade_no").rowsBetween(Window.unboundedPreceding, 0)
    points = trades.select("symbol", (F.col("trade_no") + 1).alias("point"), F.sum("profit").over(w).alias("equity"))
    return points.union(trades.select("symbol", F.lit(0).cast("long"), F.lit(0.0)).distinct())
